"""Main text of web pages: markup and a suffix array over each host's pages decide together.

A page is cut into blocks. All visible text of all pages of a host, articles too, forms one token
stream; its suffixes, sorted by their first `run` tokens, put equal runs side by side. A run on
enough pages with different texts around it is boilerplate; copies of one page, told by the least
of four hashes each of their runs, count once. A page of which nothing but short stretches, a
fifth of it at most, is not covered by such runs is an edited copy and keeps them. Markup is the
other input: what sits in menus, headers, footers, sidebars, notices, adverts, forms and comments
goes; of a page with an article or main element only that is main text. There names of classes
count only where they are nothing but adverts, comments and the like, never at headings and
passages, a header belongs to the article, and a run must be on ten pages, or on half of those of
its host. Boilerplate runs that join to a whole block, or to a long part of one, are removed; the
rest of the block stays.

Hosts are dealt to groups of a bounded number of tokens. A host too large for one group is split
by page; the contexts of its runs are counted over all its groups. First each group tells the
leading bits of its runs' hashes, eight or more values for each token of all hosts, packed; only
runs whose bits occur often enough in all groups then go out with their whole hash and contexts.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, prefer_small_batches

_GROUP_TOKENS = 500_000
#: Large hosts that are broadcast, 16 bytes each; more are joined by a shuffle.
_BROADCAST_ROWS = 500_000
#: Different contexts that make a run boilerplate, elsewhere and inside main elements; tokens of a part of a block that goes.
_CONTEXTS, _MAIN_CONTEXTS, _LONG = 3, 10, 20
#: Share of a page that is covered where it is an edited copy of others, with no long part uncovered.
_COPY = 0.8
#: Hash functions whose least values name a page's context.
_LEAST = 4

# Fixed values of HTML and of common practice.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp head".split())
#: Elements whose text is not shown; the end of an element around them ends them too.
_HIDDEN = frozenset("noscript template svg math select option object".split())
#: Those of them that a block ends.
_BROKEN = frozenset("svg math select option".split())
_OUT_TAGS = frozenset("nav header footer aside form button dialog menu search datalist label".split())
_MAIN_TAGS = frozenset("article main".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer header masthead topbar toolbar skip share sharing social related recommended "
    "comment comments commentlist reply replies respond disqus discussion".split()
)
#: Classes and ids, whole, that rule out a part of an article or main element.
_OUT_INSIDE = frozenset("ad ads advert adverts advertisement sponsored cookie-notice newsletter subscribe share share-buttons sharing social social-share comment comments comment-list commentlist disqus_thread respond breadcrumb breadcrumbs pagination".split())
#: Elements that names do not rule out inside such an element; tags that do not.
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption table tbody tr td th dl dt dd li".split())
_INSIDE_TAGS = frozenset("header label datalist".split())
#: An end tag of an inline element does not reach beyond one of these.
_BARRIERS = _BLOCKS - _HIDDEN
#: An open p ends where one of these begins.
_ENDS_P = _BLOCKS - {"body", "html", "caption", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/a-zA-Z!?][^>]*+(?:>|\Z)|([^<]++|<)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _is_out(tag: str, attrs: str, inside: bool = False) -> bool:
    """Whether an element's own markup says that it is not main text; inside: of an article or main element."""
    if tag in _OUT_TAGS and not (inside and tag in _INSIDE_TAGS):
        return True
    if not attrs or tag in ("body", "html") or tag in _MAIN_TAGS:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and (tag not in _TEXT_TAGS and not _OUT_INSIDE.isdisjoint(value.split()) if inside else not _OUT_NAMES.isdisjoint(_NAME.findall(value))):
            return True
        if name == "role" and value.strip() in _OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, whether markup rules it out, whether it is in an article) of each block, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, rules out, is main
    ruled, mains, hidden, held = 0, 0, 0, []
    lower, ends = page.lower(), {}

    def close() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, ruled > 0, mains > 0))

    def pop_to(k: int) -> None:
        nonlocal ruled, mains, hidden
        while len(stack) > k:
            tag, o, m = stack.pop()
            ruled -= o
            mains -= m
            hidden -= tag in _HIDDEN

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[4]
        if text is not None:
            if not hidden:
                held.append(text)
            continue
        if m[2] is None:  # a comment, a declaration, or a tag that the page's end cuts
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag in _BLOCKS or tag in _OUT_TAGS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in _BARRIERS and tag not in _BLOCKS:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _RAW:
            if tag == "head":
                # Its elements are raw or void; anything else begins the body.
                continue
            if not attrs.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in _HIDDEN:
            if tag not in ends:
                ends[tag] = lower.rfind(f"</{tag}")
            # Without an end, only an option hides what follows: it ends with its list.
            if not attrs.endswith("/") and (ends[tag] >= at or tag == "option" and stack and stack[-1][0] in ("option", "select", "datalist", "optgroup")):
                stack.append((tag, False, False))
                hidden += 1
            continue
        if tag in _BLOCKS:
            while stack and stack[-1][0] in _BROKEN:
                pop_to(len(stack) - 1)
        if tag in _BLOCKS or tag in _OUT_TAGS:
            close()
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in _BLOCKS or stack[k][0] in _HIDDEN:
                    break
        if tag in _VOID or attrs.endswith("/"):
            continue
        o, main = _is_out(tag, attrs, mains > 0), tag in _MAIN_TAGS or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs) is not None
        stack.append((tag, o, main))
        ruled += o
        mains += main
    close()
    return out


def suffix_order(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a run of one page begins at each place, those places by their run, where in them another run begins).

    Suffixes are ranked by their first tokens, then by as many ranks as fit one number, which
    makes the ranked length grow at least twofold, up to `run`; then equal ranks are neighbours
    in the suffix array. Pages' parts are contiguous.
    """
    n = len(tokens)
    inside = np.zeros(n, bool)
    if n >= run:
        inside[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    order = np.flatnonzero(inside)
    if not len(order):
        return inside, order, np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    bits, length = (n + 1).bit_length(), 1
    while True:
        key, reach, ranks = rank.copy(), length, 1
        while reach < run and ranks < 63 // bits:
            step = min(length, run - reach)
            at = reach + step - length  # ranks may overlap; the last one ends at `run`
            key <<= bits
            key[: n - at] |= rank[at:] + 1
            reach, ranks = reach + step, ranks + 1
        if reach >= run:
            break
        rank, length = np.unique(key, return_inverse=True)[1].astype(np.int64), reach
    by = np.argsort(key[order])  # the suffix array, as far as `run` tokens
    order, r = order[by], key[order[by]]
    return inside, order, np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a stream of tokens: whether a run of `run` tokens of one page begins there, and whether it is found on another page too."""
    inside, order, begin = suffix_order(tokens, page, run)
    again = np.zeros(len(tokens), bool)
    if len(order):
        p = page[order]
        several = np.minimum.reduceat(p, begin) != np.maximum.reduceat(p, begin)
        again[order] = np.repeat(several, np.diff(np.append(begin, len(order))))
    return inside, again


def grams(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of the run at each place that has one."""
    n = max(len(tokens) - run + 1, 0)
    gram = np.zeros(n, np.uint64)
    for k in range(run):
        gram = (gram ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    return gram


_PARSED = "page_id long, url string, packed binary, kinds string, host long, context long, split boolean, needed int, g long"


def _hashes(text: str, host: int) -> np.ndarray:
    """A hash of each token of blocks joined by line feeds."""
    import xxhash

    digest, seed = xxhash.xxh3_64_intdigest, host % 2**64
    return np.array([digest(w, seed) for w in text.encode("utf-8", "surrogatepass").split()], np.uint64)


def _context(gram: np.ndarray) -> int:
    """One number for a page's runs: their least hashes under several hash functions, which pages that share half their text seldom have in common."""
    context = 0
    for _ in range(_LEAST):
        context = (context * 31 ^ int(gram.min())) % 2**64
        gram = mix64(gram)
    return context - 2**63


def _parse(run: int):
    """Pages -> their blocks, joined by line feeds and compressed, what markup says of each, and the page's context."""

    def parse(batches):
        import pyarrow as pa
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, site, page in zip(*(batch.column(c).to_pylist() for c in ("row", "site", "html"))):
                blocks = blocks_of(page or "")
                host = xxhash.xxh3_64_intdigest(site.encode()) - 2**63
                # The context is that of the text markup leaves; a page too short for a run is one of its own.
                gram = grams(_hashes("\n".join(t for t, o, _ in blocks if not o), host), run)
                out[0].append(pack("\n".join(t for t, _, _ in blocks).encode("utf-8", "surrogatepass")))
                out[1].append("".join(str(2 * o + m) for _, o, m in blocks))
                out[2].append(host)
                out[3].append(_context(gram) if len(gram) else row)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.string(), pa.int64(), pa.int64()))]
            named = {"page_id": batch.column("page_id"), "url": batch.column("url"), "packed": arrays[0], "kinds": arrays[1], "host": arrays[2], "context": arrays[3]}
            yield pa.RecordBatch.from_pydict(named | {c: batch.column(c) for c in ("split", "needed", "g")})

    return parse


def _texts(table) -> list[str]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x).decode("utf-8", "surrogatepass") for x in table.column("packed").to_pylist()]


class _Stream:
    """A group's pages as one stream of tokens, its suffix order, and the contexts of its runs."""

    def __init__(self, table, run: int, texts: list[str] | None = None) -> None:
        parts = [_hashes(t, h) for t, h in zip(_texts(table) if texts is None else texts, table.column("host").to_pylist())]
        self.sizes = [len(t) for t in parts]
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *parts])
        page = np.repeat(np.arange(len(parts)), self.sizes)
        context = table.column("context").to_numpy()
        self.context = np.repeat(context, self.sizes)
        known, number = np.unique(context, return_inverse=True)
        self.number, self.known = np.repeat(number, self.sizes), max(1, len(known))
        _, self.order, self.begin = suffix_order(self.tokens, page, run)
        self.gram = grams(self.tokens, run)

    def runs(self) -> np.ndarray:
        """The hash of each run, in suffix order."""
        return self.gram[self.order[self.begin]]

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, a place of it in each of its contexts, how many of its contexts came before), runs numbered as in begin."""
        which = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(self.order))))
        key = which * self.known + self.number[self.order]
        by = np.argsort(key)
        new = np.flatnonzero(np.diff(key[by], prepend=-1))
        w = which[by][new]
        return w, self.order[by][new], np.arange(len(w)) - np.searchsorted(w, w)


def _of_split_hosts(table):
    import pyarrow.compute as pc

    return table.filter(pc.fill_null(table.column("split"), False))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values below 2**64 as differences, byte plane by byte plane."""
    import zstandard

    step = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(step.tobytes())


def unpack_sorted(packed: bytes) -> np.ndarray:
    import zstandard

    step = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(step).view("<u8").ravel(), dtype=np.uint64)


def _cut(values: np.ndarray, ranges: int, bits: int) -> list[tuple[int, np.ndarray]]:
    """Ascending values below 2**bits, by ranges of equal width."""
    width = (1 << bits) // ranges + 1
    r = (values // np.uint64(width)).astype(np.int64)
    at = np.flatnonzero(np.diff(r, prepend=-1)) if len(r) else np.zeros(0, np.int64)
    return [(int(r[i]), values[i:j]) for i, j in zip(at, np.append(at[1:], len(r)))]


def _sketch(run: int, ranges: int, bits: int):
    """A group -> r, g, packed: the first bits of the hashes of its runs on split hosts, as often as they have contexts (enough to decide at most)."""

    def sketch(table):
        import pyarrow as pa

        g, table = table.column("g")[0].as_py(), _of_split_hosts(table)
        s = _Stream(table, run)
        _, place, nth = s.contexts()
        mark = np.sort(s.gram[place[nth < _CONTEXTS]] >> np.uint64(64 - bits))
        parts = _cut(mark, ranges, bits)
        return pa.table([pa.array([r for r, _ in parts], pa.int64()), pa.array([g] * len(parts), pa.int64()), pa.array([pack_sorted(v) for _, v in parts], pa.binary())], ["r", "g", "packed"])

    return sketch


def _candidates(table):
    """One range of all groups' marks -> g, packed: those that may have enough contexts, for each group that has them."""
    import pyarrow as pa

    parts = [unpack_sorted(x) for x in table.column("packed").to_pylist()]
    mark, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    often = mark[n >= _CONTEXTS]
    found = [(g, np.unique(v[np.isin(v, often)])) for g, v in zip(table.column("g").to_pylist(), parts)]
    found = [(g, v) for g, v in found if len(v)]
    return pa.table([pa.array([g for g, _ in found], pa.int64()), pa.array([pack_sorted(v) for _, v in found], pa.binary())], ["g", "packed"])


def _find(run: int, ranges: int, bits: int):
    """A group and its candidates -> r, g, gram, context: of each candidate run its contexts, no more than decide."""

    def find(table, marks):
        import pyarrow as pa

        if not table.num_rows or not marks.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, ["r", "g", "gram", "context"])
        g, table = table.column("g")[0].as_py(), _of_split_hosts(table)
        s = _Stream(table, run)
        known = np.concatenate([unpack_sorted(x) for x in marks.column("packed").to_pylist()])
        _, place, nth = s.contexts()
        place = place[nth < _MAIN_CONTEXTS]
        place = place[np.isin(s.gram[place] >> np.uint64(64 - bits), known)]
        gram = s.gram[place]
        return pa.table([pa.array((gram % np.uint64(ranges)).astype(np.int64)), pa.array(np.full(len(place), g, np.int64)), pa.array(gram.astype(np.int64)), pa.array(s.context[place])], ["r", "g", "gram", "context"])

    return find


def _count(table):
    """One range of candidate runs of all groups -> g, gram, n: the contexts of each in all groups, where they are enough."""
    import pyarrow as pa

    g, gram, context = (table.column(c).to_numpy() for c in ("g", "gram", "context"))
    by = np.lexsort((context, gram))
    a, c = gram[by], context[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    run, n = np.unique(a[new], return_counts=True)
    n = n[np.searchsorted(run, gram)]
    by = np.lexsort((gram, g))
    first = np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (gram[by][1:] != gram[by][:-1])])
    by = by[first & (n[by] >= _CONTEXTS)]
    return pa.table([pa.array(g[by]), pa.array(gram[by]), pa.array(n[by].astype(np.int64))], ["g", "gram", "n"])


def _judge(run: int):
    """A group's pages, and the counts of contexts of its runs on split hosts -> page_id, url, text."""

    def judge(table, between):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string())], ["page_id", "url", "text"])
        pages = _texts(table)
        s = _Stream(table, run, pages)
        count = np.bincount(s.contexts()[0], minlength=len(s.begin))
        if between.num_rows and len(s.begin):
            known = between.sort_by("gram")
            have, n = known.column("gram").to_numpy(), known.column("n").to_numpy()
            gram = s.runs().astype(np.int64)
            at = np.minimum(np.searchsorted(have, gram), len(have) - 1)
            count = np.maximum(count, np.where(have[at] == gram, n[at], 0))
        size = len(s.tokens)
        often = np.zeros(size + run, np.int64)
        often[s.order] = np.repeat(count, np.diff(np.append(s.begin, len(s.order))))
        # Inside main elements: ten contexts, or half of the host's, three at least.
        host = table.column("host").to_numpy()
        pairs = np.unique(np.stack([host, table.column("context").to_numpy()]), axis=1)[0]
        names, several = np.unique(pairs, return_counts=True)
        needed = np.clip((several + 1) // 2, _CONTEXTS, _MAIN_CONTEXTS)[np.searchsorted(names, host)]
        told = pc.fill_null(table.column("needed"), 0).to_numpy()  # of a split host: by all its different pages
        needed = np.where(told > 0, told, needed)
        within = np.repeat(needed, s.sizes)

        def cover(hit: np.ndarray) -> np.ndarray:
            step = np.zeros(size + run + 1, np.int64)
            step[hit] += 1
            step[hit + run] -= 1  # hits differ
            return np.cumsum(step) > 0

        covered = {False: cover(np.flatnonzero(often >= _CONTEXTS)), True: cover(np.flatnonzero(often[:size] >= within))}
        texts, at = [], 0
        for page, kinds, size in zip(pages, table.column("kinds").to_pylist(), s.sizes):
            main = "1" in kinds
            own, c, shared = "1" if main else "0", covered[main], covered[False]
            blocks, ends = page.split("\n"), []
            for b in blocks:
                ends.append((ends[-1] if ends else at) + b.count(" ") + 1)
            spans = [(b, i, j) for b, kind, i, j in zip(blocks, kinds, [at, *ends], ends) if kind == own]
            mine = [(b, c[i:j]) for b, i, j in spans]
            copy = _is_copy(np.concatenate([np.zeros(0, bool), *[shared[i:j] for _, i, j in spans]]))
            kept = [b if copy else _left(b, x) for b, x in mine]
            texts.append("\n".join(filter(None, kept)))
            at += size
        return pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return judge


def _is_copy(covered: np.ndarray) -> bool:
    """Whether a page's text is an edited copy: covered to four fifths by runs of several contexts, and nowhere uncovered for long.

    A page of a notice and a text of its own has the notice covered and its own text, in one
    stretch, not; a copy's edits are short and between covered parts.
    """
    if not covered.any() or covered.mean() <= _COPY:
        return False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~covered).astype(np.int8), [0]])))
    return not len(edge) or int((edge[1::2] - edge[::2]).max()) < _LONG


def _left(block: str, covered: np.ndarray) -> str:
    """A block without its covered parts that are long or the whole block."""
    if not covered.any():
        return block
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    words, out, at = block.split(" "), [], 0
    for i, j in zip(edge[::2], edge[1::2]):
        if j - i >= _LONG or j - i == len(words):
            out += words[at:i]
            at = j
    return " ".join(out + words[at:])


def _needed(n):
    """Contexts that make a run inside main elements boilerplate, on a host of n different pages."""
    return F.greatest(F.lit(_CONTEXTS), F.least(F.lit(_MAIN_CONTEXTS), F.ceil(n / 2))).cast("int")


def extract(pages: DataFrame, run: int = 5) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages(page_id, url, html).

    Character references are decoded; white space inside a block becomes one space; blocks are
    trimmed and joined by a line feed. A null or empty page has an empty text. A null url, or
    one without a host, counts as the host ''. Rows that repeat stay apart, but are one context:
    what only they say is not boilerplate. Other columns are ignored; an empty table stays empty.
    """
    site = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    p = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), site.alias("site"))
    p = p.withColumn("host", F.xxhash64("site"))
    # Sizes in tokens, at eight bytes of page each.
    sizes = materialize(p.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) / 8).alias("n"), F.count_distinct(F.xxhash64("html")).alias("pages")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = sizes.where(F.col("n") > _GROUP_TOKENS).select("host", F.ceil(F.col("n") / _GROUP_TOKENS).alias("shards"), _needed(F.col("pages")).alias("needed"))
    if large.count() <= _BROADCAST_ROWS:
        large = F.broadcast(large)
    groups = int(total / _GROUP_TOKENS) * 2 + 1
    ranges = min(groups // 8 + 1, max(_GROUP_TOKENS // 8, 1))
    bits = min(max(int(total), 1).bit_length() + 3, 63)
    p = p.join(large, "host", "left").withColumn("split", F.col("shards").isNotNull())
    p = p.withColumn("g", F.pmod(F.xxhash64("host", F.pmod(F.xxhash64("row"), F.coalesce("shards", F.lit(1)))), F.lit(groups)))
    prefer_small_batches(pages.sparkSession, 500)
    # One shuffle of the packed texts, which all three passes read: they must ask for the same columns.
    s = p.select("row", "page_id", "url", "html", "site", "split", "needed", "g").mapInArrow(_parse(run), _PARSED).repartition("g")
    marks = s.groupBy("g").applyInArrow(lambda t: _sketch(run, ranges, bits)(t), "r long, g long, packed binary")
    marks = marks.groupBy("r").applyInArrow(lambda t: _candidates(t), "g long, packed binary")
    runs = s.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(lambda a, b: _find(run, ranges, bits)(a, b), "r long, g long, gram long, context long")
    between = runs.groupBy("r").applyInArrow(lambda t: _count(t), "g long, gram long, n long")
    out = s.groupBy("g").cogroup(between.groupBy("g")).applyInArrow(lambda a, b: _judge(run)(a, b), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
