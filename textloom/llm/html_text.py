"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text that no block element or line break interrupts, each
with its open elements. Features tell the ancestors' tags and the words of their class, id and role, the
block's length, its share of link text and its punctuation. Two states (article, rest) form a chain over
the blocks in page order; weights are fitted by maximum likelihood on labelled pages and pages are
decoded by Viterbi's algorithm. The labelled pages are written by ``labelled_pages``, which varies
layouts, element names and class words, so that no page of the table at hand is needed to fit.

A null html counts as empty and gives an empty text, as does a page without article blocks. Repeated rows
give repeated rows, an empty table an empty result; other columns are ignored; pages are read whole, in
time in proportion to their length (but for the logarithm of a search), and broken markup is read as it
comes: a missing end tag is implied by the parent's, a stray one is ignored, a < that begins no tag is text.
"""

from __future__ import annotations

import html
import json
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"
TRAIN_PAGES = 400
TRAIN_STEPS = 150

#: Fixed sets of element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag without looking for elements in it; those of the
#: first kind take the rest of the page where it is missing, the others are then empty.
RAW_TO_END, RAW = frozenset("script style".split()), frozenset("textarea iframe".split())
#: Elements whose text is never shown; they end with their parent at the latest.
SKIPPED = frozenset("noscript template svg math object select".split())
#: Of these, those that any block element ends.
FOREIGN = frozenset("svg math select".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead div section article main aside nav header footer form body html blockquote td".split())
#: Elements that end an open paragraph when they begin.
PARAGRAPH_ENDS = SCOPES | frozenset("p h1 h2 h3 h4 h5 h6 pre hr figure fieldset address details".split())

#: A tag without stray quotes; no part of it is tried twice, and none passes another tag's beginning.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>""")
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

Block = tuple[frozenset | int, str, float]


class Places:
    """Finds marks behind a place; searches that found nothing, or something far ahead, are not repeated."""

    def __init__(self, page: str) -> None:
        self.page, self.known, self.marks, self.ends = page, {}, {}, {}

    def after(self, mark: str, at: int) -> int:
        """Place of the next ``mark`` from ``at`` on, or -1. Asked for with rising places."""
        low, found = self.known.get(mark, (len(self.page) + 1, -1))
        if not (low <= at and (found < 0 or at <= found)):
            found = self.page.find(mark, at)
            self.known[mark] = at, found
        return found

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at ``at``, quotes kept together, or -1.
        What lies behind a quotation is the same for all tags that reach it, and is worked out once."""
        path = []
        while True:
            event = min((x for x in (self._next(m, at) for m in ">\"'") if x >= 0), default=-1)
            if event in self.ends:
                found = self.ends[event]
                break
            path.append(event)
            if event < 0 or self.page[event] == ">":
                found = event
                break
            close = self._next(self.page[event], event + 1)
            if close < 0:
                found = -1
                break
            at = close + 1
        for event in path:
            self.ends[event] = found
        return found

    def _next(self, mark: str, at: int) -> int:
        table = self.marks.get(mark)
        if table is None:
            table = self.marks[mark] = [m.start() for m in re.finditer(mark, self.page)]
        i = bisect_left(table, at)
        return table[i] if i < len(table) else -1


def leaf_blocks(page: str, weights: dict[str, int] | None = None) -> list[Block]:
    """(features of the open elements, text with single spaces, share of link text) of each block; the
    features as a set, or as the sum of their ``weights`` where these are given. Open elements are held as
    counts, so that depth costs nothing."""
    found, parts, at, places = [], [], 0, Places(page)
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: dict[str, list[int]] = {}  # places in the stack by name
    scopes: list[int] = []
    features: Counter = Counter()
    missing: set[str] = set()
    linked = total = links = hidden = score = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((frozenset(features) if weights is None else score, text, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    def pop_to(k: int) -> None:
        nonlocal links, hidden, score
        while len(stack) > k:
            name, own = stack.pop()
            opened[name].pop()
            links -= name == "a"
            hidden -= name in SKIPPED
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            for f in own:
                features[f] -= 1
                if not features[f]:
                    del features[f]
                    if weights is not None:
                        score -= weights.get(f, 0)

    def add_text(token: str) -> None:
        nonlocal linked, total
        if not hidden:
            parts.append(token)
            n = len(token.strip())
            total += n
            linked += n if links > 0 else 0

    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            add_text(page[at:end])
            at = end
            continue
        if page.startswith("<!--", at):
            end = places.after("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = places.after(">", at)
            if end < 0:
                add_text("<")
                at += 1
            else:
                at = end + 1
            continue
        match = TAG.match(page, at)
        if match:
            closing, name, attributes, at = match[1], match[2].lower(), match[3], match.end()
        else:
            match = OPENING.match(page, at)
            end = -1
            if match:
                end = places.tag_end(match.end())
                if end < 0:
                    end = places.after(">", match.end())  # quotes that never end are no quotes
            if end < 0:
                add_text("<")
                at += 1
                continue
            closing, name, attributes, at = match[1], match[2].lower(), page[match.end() : end], end + 1
        if name not in INLINE:
            flush()
        if closing:
            if opened.get(name):
                pop_to(opened[name][-1])
            continue
        if name in RAW_TO_END or name in RAW:
            end = None if name in missing else re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            if end:
                close = page.find(">", end.end())
                at = close + 1 if close >= 0 else len(page)
            elif name in RAW_TO_END:
                at = len(page)
            else:
                missing.add(name)
            continue
        if name in VOID:
            continue
        if name in PARAGRAPH_ENDS and hidden:
            for kind in FOREIGN:
                if opened.get(kind) and opened[kind][-1] > (scopes[-1] if scopes else -1):
                    pop_to(opened[kind][-1])
        closes = CLOSES.get(name) or ({"p"} if name in PARAGRAPH_ENDS else None)
        if closes:
            k = max((opened[c][-1] for c in closes if opened.get(c)), default=-1)
            own_scope = [x for x in scopes[-1:] if stack[x][0] not in closes]
            if k >= 0 and k > (own_scope[0] if own_scope else -1):
                pop_to(k)
        words = [w for g in NAMES.findall(attributes) for w in PART.findall("".join(g).lower())] if attributes else []
        own = (*([f"t:{name}"] if name not in INLINE else []), *[f"c:{w}" for w in words])
        opened.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append((name, own))
        links += name == "a"
        hidden += name in SKIPPED
        for f in own:
            features[f] += 1
            if features[f] == 1 and weights is not None:
                score += weights.get(f, 0)
    flush()
    return found


def own_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    size = "1" if words < 2 else "5" if words < 6 else "15" if words < 16 else "40" if words < 41 else "more"
    link = "none" if linked < 0.05 else "some" if linked < 0.5 else "most"
    return [f"size:{size}", f"link:{link}", f"stop:{text[-1] in '.!?:;'}", f"comma:{',' in text}", "always"]


#: Weights are whole numbers of this part, so that sums are the same in any order.
UNIT = 100_000


class Crf:
    def __init__(self, weights: dict[str, int], moves: list[list[float]], first: list[float]) -> None:
        self.weights, self.moves, self.first = weights, moves, first

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "moves": self.moves, "first": self.first})

    def emission(self, block: Block) -> float:
        return (block[0] + sum(self.weights.get(f, 0) for f in own_features(block[1], block[2]))) / UNIT

    def decode(self, blocks: list) -> list[bool]:
        """Viterbi: state 1 is article; its emission is weighed against 0."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.moves
        a, b = self.first[0], self.first[1] + self.emission(blocks[0])
        back = []
        for block in blocks[1:]:
            e = self.emission(block)
            from_rest, from_article = b + s10 > a + s00, b + s11 >= a + s01
            back.append((from_rest, from_article))
            a, b = (b + s10 if from_rest else a + s00), (b + s11 if from_article else a + s01) + e
        states = [b >= a]
        for from_rest, from_article in reversed(back):
            states.append(from_article if states[-1] else from_rest)
        return states[::-1]

    def text(self, page: str) -> tuple[str, int]:
        blocks = leaf_blocks(page, self.weights)
        kept = [block[1] for block, yes in zip(blocks, self.decode(blocks), strict=True) if yes]
        return "\n".join(kept), len(blocks)


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their article blocks. Every block's text is unique within its page."""
    rng = random.Random(seed)
    letters = "etaoinsrhldcumfpgwybvk"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        text = ", ".join(words(2, 9) for _ in range(rng.randint(1, 3)))
        return text.capitalize() + rng.choice("....!?")

    def links(k: int) -> str:
        return "".join(f"<li><a href='/{words(1, 1)}'>{words(1, 3)}</a></li>" for _ in range(k))

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, 6)))

    rest = {
        "menu": lambda: rng.choice(["<nav{}><ul>{}</ul></nav>", "<div class='menu navbar'{}><ul>{}</ul></div>", "<ul class='nav breadcrumb'{}>{}</ul>"]).format("", links(rng.randint(1, 7))),
        "header": lambda: rng.choice(["<header class='site-header'><a href='/'>{}</a><p>{}</p></header>", "<div id='header' class='masthead'><h2>{}</h2><p>{}</p></div>"]).format(words(1, 3), words(2, 8)),
        "footer": lambda: rng.choice(["<footer>&copy; {} &middot; {}</footer>", "<div id='footer' class='copyright'><p>&copy; {}</p><p>{}</p></div>", "<footer class='site-footer'><p>{}</p><p>{}</p></footer>"]).format(words(1, 3), prose()),
        "aside": lambda: rng.choice(["<aside><h3>{}</h3><p>{}</p></aside>", "<div class='sidebar widget'><h3>{}</h3><p>{}</p></div>", "<aside class='related'><h4>{}</h4><ul><li>{}</li></ul></aside>", "<section class='recommended related-posts'><h3>{}</h3><p>{}</p></section>"]).format(words(1, 3), prose()),
        "advert": lambda: rng.choice(["<div class='ad'>{}</div>", "<div class='ads advert banner'>{}</div>", "<div class='sponsored promo'><p>{}</p></div>", "<section id='advertisement'>{}</section>", "<ins class='adsbygoogle'><div class='ad-slot'>{}</div></ins>"]).format(prose()),
        "notice": lambda: rng.choice(["<div class='cookie notice'><p>{}</p><button>{}</button></div>", "<div role='alert' class='cookie-banner consent popup'>{}<p>{}</p></div>", "<div class='newsletter subscribe modal'><p>{}</p><p>{}</p></div>"]).format(prose(), words(1, 3)),
        "form": lambda: "<form class='search login'><label>{}</label><input type='text'><button>{}</button></form>".format(words(1, 6), words(1, 2)),
        "comments": lambda: rng.choice(["<div class='comments' id='comments'><h3>{}</h3><div class='comment'><p>{}</p></div></div>", "<section id='comments' class='comment-list'><h4>{}</h4><ol><li class='comment reply'><p>{}</p></li></ol></section>", "<ul class='responses discussion comments'><li>{}</li><li>{}</li></ul>"]).format(words(1, 3), prose()),
        "share": lambda: "<div class='share social tags'><a href='#'>{}</a> <a href='#'>{}</a></div>".format(words(1, 1), words(1, 1)),
    }
    pages = []
    for _ in range(n):
        keep, body = [], []

        def article(keep: list = keep) -> str:
            out, heading = [], words(2, 10).capitalize()
            level = rng.choice(["h1", "h1", "h2"])
            if rng.random() < 0.85:
                keep.append(heading)
                out.append(f"<{level}>{heading}</{level}>")
            for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
                text, kind = (prose() if rng.random() < 0.85 else words(1, 4)), rng.random()
                keep.append(text)
                if kind < 0.7:
                    out.append(f"<p>{text}</p>")
                elif kind < 0.8:
                    out.append(f"<p><b>{text}<br>")
                elif kind < 0.87:
                    out.append(f"<ul><li>{text}</li></ul>")
                elif kind < 0.93:
                    out.append(f"<blockquote>{text}</blockquote>")
                else:
                    out.append(f"<h2>{text}</h2>")
                if rng.random() < 0.1:
                    out.append(rest[rng.choice(["advert", "share", "aside", "form", "notice"])]())
            return "".join(out)

        opening, close = rng.choice(
            [("<article>", "</article>")] * 4
            + [("<main>", "</main>"), ("<article class='post entry'>", "</article>"), ("<div class='content article-body'>", "</div>")]
            + [("<main id='main'><article>", "</article></main>"), ("<div id='content' class='post'>", "</div>"), ("<section class='entry-content story'>", "</section>")]
        )
        for kind in rng.sample(["menu", "header", "advert", "notice", "form"], rng.randint(1, 4)):
            body.append(rest[kind]())
        body.append(opening + article() + close)
        if rng.random() < 0.3:
            body.append("</div></p>")
        for kind in rng.sample(["comments", "aside", "advert", "footer", "share", "menu", "form"], rng.randint(1, 4)):
            body.append(rest[kind]())
        if rng.random() < 0.7:
            body.append(rest["footer"]())
        title = words(2, 8)
        pages.append((f"<html><head><title>{title}</title></head><body>{''.join(body)}</body></html>", [" ".join(t.split()) for t in keep]))
    return pages


def fit(pages: list[tuple[str, list[str]]], steps: int = TRAIN_STEPS, rate: float = 0.15, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood by forward-backward over all pages at once, padded to the longest."""
    names: dict[str, int] = {}
    rows, longest = [], 0
    for page, kept in pages:
        blocks = leaf_blocks(page)
        left = list(kept)
        row = []
        for block in blocks:
            yes = block[1] in left
            if yes:
                left.remove(block[1])
            row.append(([names.setdefault(f, len(names)) for f in sorted({*block[0], *own_features(block[1], block[2])})], yes))
        if row:
            rows.append(row)
            longest = max(longest, len(row))
    n, m = len(rows), len(names)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    cell, feat = [], []
    for i, row in enumerate(rows):
        for j, (fs, yes) in enumerate(row):
            mask[i, j], gold[i, j] = True, yes
            cell += [i * longest + j] * len(fs)
            feat += fs
    cell, feat = np.array(cell), np.array(feat)
    theta, first, second = np.zeros(m + 6), np.zeros(m + 6), np.zeros(m + 6)
    for step in range(1, steps + 1):
        e = np.bincount(cell, theta[feat], n * longest).reshape(n, longest)
        moves, start = theta[m : m + 4].reshape(2, 2), theta[m + 4 :]
        emit = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + emit[:, 0]
        for j in range(1, longest):
            new = np.logaddexp(alpha[:, j - 1, :1] + moves[0], alpha[:, j - 1, 1:] + moves[1]) + emit[:, j]
            alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            ahead = beta[:, j + 1] + emit[:, j + 1]
            new = np.stack([np.logaddexp(moves[s, 0] + ahead[:, 0], moves[s, 1] + ahead[:, 1]) for s in (0, 1)], axis=1)
            beta[:, j] = np.where(mask[:, j + 1, None], new, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
        grad = np.zeros(m + 6)
        miss = (p - gold * mask).ravel()
        grad[:m] = np.bincount(feat, miss[cell], m)
        for s in (0, 1):
            for t in (0, 1):
                q = np.exp(alpha[:, :-1, s] + moves[s, t] + emit[:, 1:, t] + beta[:, 1:, t] - z[:, None]) * mask[:, 1:]
                seen = (gold[:, :-1] == s) & (gold[:, 1:] == t) & mask[:, 1:]
                grad[m + 2 * s + t] = q.sum() - seen.sum()
        grad[m + 5] = (p[:, 0] - gold[:, 0]).sum()
        grad[m + 4] = -grad[m + 5]
        grad = grad / n + ridge * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = {f: round(float(theta[i]) * UNIT) for f, i in names.items()}
    return Crf(weights, theta[m : m + 4].reshape(2, 2).round(5).tolist(), theta[m + 4 :].round(5).tolist())


def extract_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """The main text of every page, in one pass without a shuffle."""
    told = pages.sparkSession.sparkContext.broadcast((model or fit(labelled_pages(TRAIN_PAGES))).to_json())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(**json.loads(told.value))
        for batch in batches:
            found = [crf.text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([t for t, _ in found], pa.string()),
                    pa.array([len(t) for t, _ in found], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(work, SCHEMA)
