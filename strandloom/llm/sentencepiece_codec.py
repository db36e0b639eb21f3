"""SentencePiece encoding and decoding, as the model's own type says.

No piece holds a word mark after another character, so a text falls into words that are encoded
on their own by the library and remembered for a while; for unigram models, whose encoding is
the segmentation with the largest sum of scores, here by the same rule where single precision
would not hold the sums.

A giant text is a max-plus scan. It is split into chunks of rows; a chunk's state at its ends is
the piece across the boundary. Each chunk gives the matrix of best scores from entry to exit
state; matrices combine associatively, which fixes the states at all boundaries; then every
chunk traces its own path between its two states. No task holds more than one chunk's text, and
results are those of the whole text.

Of a unigram model a state is how far that piece reaches into the next chunk, and scores are the
pieces'. A BPE model merges pairs by rank, which is no sum of scores. But a merge sees its two
neighbours only, so pieces are a text's encoding exactly if each encodes as itself and each two
neighbours, joined, encode as these two: scores are 0 for such neighbours and minus infinity for
others, and one path has the sum 0. Its states are both ends of the piece across the boundary.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefer_small_batches, slices_by_bytes, trimmed

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Texts of more code points are split into chunks of so many.
GIANT, CHUNK = 65536, 8192
#: Bytes of remembered words and numbers of remembered pairs of a worker; code points that it encodes at a time.
_MEMORY, _PAIRS, _SLICE = 16 << 20, 200_000, 1 << 19
#: Code points of giant texts to a task.
_DEALT = 1 << 18
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_LOADED: dict[int, "Pieces"] = {}
_ENCODERS: dict[int, "Pieces"] = {}


class Pieces:
    """A model's vocabulary: pieces with ids and scores, single bytes for other characters."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback or not spec.add_dummy_prefix:
            raise NotImplementedError("only models without normalisation rules, with a dummy prefix and byte fallback")
        # Prefixes of pieces lead nowhere themselves but let the search go on.
        self.found: dict[str, tuple[int, float] | None] = {}
        self.bytes, self.raw = [0] * 256, []
        scores = []
        for i, p in enumerate(m.pieces):
            if p.type in (_NORMAL, _USER):
                if MARK in p.piece.lstrip(MARK):
                    raise NotImplementedError("a piece spans words")
                for k in range(1, len(p.piece)):
                    self.found.setdefault(p.piece[:k], None)
                self.found[p.piece] = (i, float(p.score))
                scores.append(float(p.score))
                self.raw.append(p.piece.replace(MARK, " ").encode())
            elif p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.raw.append(" ⁇ ".encode() if p.type == _UNKNOWN else b"")
        self.unknown = min(scores) - 10.0
        self.longest = max(len(p) for p, v in self.found.items() if v)
        alone = {p for p, v in self.found.items() if v and len(p) == 1 and p != MARK}
        every = {c for p in self.found for c in p} - {MARK}
        single = re.escape("".join(sorted(alone)))
        # Control characters that no piece has are words of their own.
        alien = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in every) or "\ufffe"
        self.split = re.compile(f"{MARK}*[^{alien}{MARK}]+|{MARK}+|[{alien}]").findall
        # The library sums in single precision, which is exact for whole scores below 2 ** 24. Scores
        # far below all others (this model's lone marks) become the least that keeps their order.
        usual = [x for x in scores if x > -1e8]
        reach = int(2**23 // max(1.0, -min(usual, default=0.0))) - 1 if all(x == int(x) for x in usual) else 0
        self.plain = re.compile(f"{MARK}?[{single}]{{1,{reach}}}").fullmatch if reach > 1 else lambda w: None
        m.trainer_spec.model_type = 1
        m.normalizer_spec.add_dummy_prefix = False
        for p in m.pieces:
            p.score = max(p.score, -float(2**23))
        self.library = None
        self.model = m.SerializeToString()
        self.words: dict[str, bytes] = {}
        self.held = 0

    def steps(self, text: str, i: int, most: int):
        """(end, score) of each piece at i that ends by most; a character without a piece is unknown."""
        get, single = self.found.get, False
        for j in range(i + 1, min(i + self.longest, most) + 1):
            s = text[i:j]
            v = get(s)
            if v is not None:
                single = single or j == i + 1
                yield j, v[1]
            elif s not in self.found:
                break
        if not single:
            yield i + 1, self.unknown

    def forward(self, text: str, start: int, until: int, end: int) -> tuple[list, list]:
        """Best score of reaching each place up to end from start by pieces that begin before until, and where the last of them begins."""
        score: list = [None] * (end + 1)
        back = [0] * (end + 1)
        score[start] = 0.0
        for i in range(start, until):
            if score[i] is None:
                continue
            for j, v in self.steps(text, i, end):
                new = score[i] + v
                if score[j] is None or new > score[j]:  # an earlier start is a longer last piece: it stays on ties
                    score[j], back[j] = new, i
        return score, back

    def best(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """Ids of the best path from start to end; of equal ones that whose last piece, and so on backwards, is longest."""
        end = len(text) if end is None else end
        back = self.forward(text, start, end, end)[1]
        out, j = [], end
        while j > start:
            i = back[j]
            v = self.found.get(text[i:j])
            out.append([v[0]] if v else [self.bytes[b] for b in text[i:j].encode()])
            j = i
        return [x for ids in reversed(out) for x in ids]

    def matrix(self, text: str, n: int, last: bool, aligned: bool) -> np.ndarray:
        """(L, L): score of the best path from entry state to exit state of a chunk of n characters.

        text goes on after the chunk's n characters for as long as a piece can reach. An aligned
        chunk begins with a word, which no piece crosses: its only entry state is 0.
        """
        size = self.longest
        if aligned:
            out = np.full((size, size), -np.inf)
            reached = self.forward(text, 0, n, len(text))[0][n : n + (1 if last else size)]
            out[0, : len(reached)] = [-np.inf if x is None else x for x in reached]
            return out
        score = np.full((n + size, size), -np.inf)
        k = min(size, n + 1)
        score[np.arange(k), np.arange(k)] = 0.0
        for i in range(n):
            for j, v in self.steps(text, i, len(text)):
                np.maximum(score[j], score[i] + v, out=score[j])
        out = score[n : n + size].T.copy()
        if last:
            out[:, 1:] = -np.inf
        return out

    def encode_all(self, texts: list[str], ready: bool = False) -> list[bytes]:
        """Ids of each text, or of parts of normalized texts that begin with a word (ready), as little-endian int32."""
        split = [self.split(t if ready else normalized(t)) for t in texts]
        if self.held > _MEMORY:
            self.forget()
        words = self.words
        new = {w for ws in split for w in ws if w not in words}
        plain = [w for w in new if self.plain(w)]
        if plain:
            if self.library is None:
                import sentencepiece

                self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            for w, ids in zip(plain, self.library.encode(plain, num_threads=1)):
                words[w] = array("i", ids).tobytes()
        for w in new.difference(plain):
            words[w] = array("i", self.best(w)).tobytes()
        # About what two small objects and their place in the dictionary take besides their contents.
        self.held += sum(200 + 2 * len(w) + len(words[w]) for w in new)
        return [b"".join(map(words.__getitem__, ws)) for ws in split]

    def forget(self) -> None:
        self.words.clear()
        self.held = 0

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Merges(Pieces):
    """A BPE model: words are encoded by the library with the model's own merges."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        super().__init__(model)
        m = pb.ModelProto()
        m.ParseFromString(model)
        if any(p.type == _USER for p in m.pieces):
            raise NotImplementedError("pieces that are cut out before any merge")
        m.normalizer_spec.add_dummy_prefix = False
        self.model = m.SerializeToString()
        self.plain = lambda w: True
        self.pairs: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> list[int]:
        v = self.found.get(piece)
        return [v[0]] if v else [self.bytes[b] for b in piece.encode()]

    def joins(self, x: str, y: str) -> bool:
        """Whether two pieces, joined, encode as these two; with an empty x, whether y encodes as itself."""
        k = x, y
        if k not in self.pairs:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[k] = self.merged(x + y) == (self.ids(x) if x else []) + self.ids(y)
        return self.pairs[k]

    def merged(self, text: str) -> list[int]:
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self.library.encode(text)

    def ends(self, text: str, i: int, most: int):
        """Where pieces that begin at i and encode as themselves end; a character without a piece is one."""
        single = False
        for j in range(i + 1, min(i + self.longest, most) + 1):
            v = self.found.get(text[i:j], ())
            if v == ():
                break
            if v is not None and self.joins("", text[i:j]):
                single = single or j == i + 1
                yield j
        if not single and text[i : i + 1] and not self.found.get(text[i : i + 1]):
            yield i + 1

    def chains(self, text: str, first: dict[tuple[int, int], int], until: int, end: int) -> tuple[list, dict]:
        """From pieces (begin, end) with sets of entries: at each end, the last pieces' begins with the entries that reach them; and each piece's neighbour before it."""
        at: list[dict[int, int] | None] = [None] * (end + 1)
        back: dict[tuple[int, int], int] = {}
        for (j, i), entries in first.items():
            at[i] = {**(at[i] or {}), j: entries}
        for i in range(min(i for _, i in first) if first else until, until):
            here = at[i]
            if not here:
                continue
            for k in self.ends(text, i, end):
                y, reach = text[i:k], 0
                for j, entries in here.items():
                    if self.joins(text[j:i], y):
                        reach |= entries
                        back[i, k] = j
                if reach:
                    if at[k] is None:
                        at[k] = {}
                    at[k][i] = reach
        return at, back

    def _first_word(self, text: str, begin: int, end: int) -> int:
        """Where the first word after begin begins; end if none does before."""
        at = text.find(MARK, begin + 1, end)
        while at >= 0 and not word_begins(text, at):
            at = text.find(MARK, at + 1, end)
        return end if at < 0 else at

    def transfer(self, text: str, off: int, n: int, aligned: bool, closed: bool) -> dict[tuple, float]:
        """Scores from entry to exit state of the chunk of n characters at off; text goes on by a piece on both sides.

        A state is (characters before the boundary, characters after it) of the piece across it or
        at its end. An aligned chunk begins with a word and a closed one ends where a word or the
        text does: no piece crosses there, and (0, 0) is the only state.
        """
        if aligned and closed:
            return {((0, 0), (0, 0)): 0.0}
        begin, end, size = off, off + n, self.longest
        if aligned:
            entries = [(0, 0)]
        else:
            entries = [(a, k - begin) for a in range(1, min(size, off) + 1) for k in self.ends(text, begin - a, len(text)) if k >= begin]
        first = {(begin - a, begin + b): 1 << x for x, (a, b) in enumerate(entries)}
        if closed:
            end = self._first_word(text, begin, end)
            at = self.chains(text, first, end, end)[0][end] or {}
            reached = {(0, 0): 0}
            for m in at.values():
                reached[0, 0] |= m
        else:
            at = self.chains(text, first, end, len(text))[0]
            reached = {(end - j, k - end): m for k in range(end, len(text) + 1) for j, m in (at[k] or {}).items() if j < end}
        return {(entry, x): 0.0 for x, m in reached.items() for i, entry in enumerate(entries) if m >> i & 1}

    def trace(self, text: str, off: int, n: int, aligned: bool, closed: bool, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the pieces that begin in the chunk, between its two states."""
        begin, end, rest = off, off + n, []
        if closed:
            stop = end if aligned else self._first_word(text, begin, end)
            rest = np.frombuffer(self.encode_all([text[begin if aligned else stop : end]], True)[0], "<i4").tolist()
            if aligned:
                return rest
            end, leave = stop, (0, 0)
        at, back = self.chains(text, {(begin - entry[0], begin + entry[1]): 1}, end, end if closed else end + leave[1])
        j, k = (next(iter(at[end])), end) if closed else (end - leave[0], end + leave[1])
        out = []
        while j >= begin + entry[1] and k > j:
            out.append(self.ids(text[j:k]))
            j, k = back[j, k], j
        return [x for ids in reversed(out) for x in ids] + rest


def is_bpe(model: bytes) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    return m.trainer_spec.model_type == pb.TrainerSpec.BPE


def normalized(text: str) -> str:
    """The model's view of a text: a dummy space before it, spaces as marks."""
    return (MARK + text.replace(" ", MARK)) if text else ""


def load(model: bytes) -> Pieces:
    k = hash(model)
    if k not in _LOADED:
        _LOADED.clear()
        _LOADED[k] = Pieces(model)
    return _LOADED[k]


def encoder(model: bytes) -> Pieces:
    """What encodes as the model's own type says."""
    k = hash((model, "encoder"))
    if k not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[k] = Merges(model) if is_bpe(model) else load(model)
    return _ENCODERS[k]


def model_bytes(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two (L, L) matrices: the best score over the middle state."""
    return (a[:, :, None] + b[None]).max(1)


def max_plus_sparse(a: dict, b: dict) -> dict:
    """The same for matrices as {(entry, exit): score}, without the entries that are minus infinity."""
    rows: dict = {}
    for (x, y), v in b.items():
        rows.setdefault(x, []).append((y, v))
    out: dict = {}
    for (e, x), v in a.items():
        for y, w in rows.get(x, ()):
            out[e, y] = max(out.get((e, y), v + w), v + w)
    return out


def prefixes(ms: list, product=max_plus) -> list:
    """All prefix products, by an associative scan: pairs first, then their scan, then the gaps."""
    if len(ms) == 1:
        return ms
    pairs = prefixes([product(a, b) for a, b in zip(ms[::2], ms[1::2])], product)
    out = [ms[0]]
    for i in range(1, len(ms)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], ms[i]))
    return out


def boundary_pieces(ms: list[dict]) -> list[tuple[tuple, tuple]]:
    """Entry and exit state of each chunk of a BPE model on the one path."""
    pre = prefixes(ms, max_plus_sparse)
    out, leave = [], (0, 0)
    for k in range(len(ms) - 1, -1, -1):
        entry = (0, 0)
        if k:
            entry = max((e for e, x in ms[k] if x == leave and ((0, 0), e) in pre[k - 1]), key=lambda e: pre[k - 1][(0, 0), e] + ms[k][e, leave])
        out.append((entry, leave))
        leave = entry
    return out[::-1]


def boundary_states(ms: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on a best path; on ties the least state."""
    pre = prefixes(ms)
    out, exit_state = [], 0
    for k in range(len(ms) - 1, -1, -1):
        entry = 0
        if k:
            entry = int(np.argmax(pre[k - 1][0] + ms[k][:, exit_state]))
        out.append((entry, exit_state))
        exit_state = entry
    return out[::-1]


def word_begins(text: str, at: int) -> bool:
    return at == 0 or (text[at] == MARK and text[at - 1] != MARK)


def cut_points(text: str, chunk: int) -> list[int]:
    """Ends of the chunks of a normalized text: at a word's beginning where there is one, else after `chunk` characters."""
    out, at = [], 0
    while len(text) - at > chunk:
        cut = at + chunk
        while cut > at and not word_begins(text, cut):
            cut = text.rfind(MARK, at, cut)
        at = cut if cut > at else at + chunk
        out.append(at)
    return [*out, len(text)]


def _split(model: bytes, chunk: int):
    def run(batches):
        import pyarrow as pa

        reach = load(model).longest - 1
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normalized(text)
                ends = cut_points(text, chunk)
                begins = [0, *ends[:-1]]
                for at in range(0, len(ends), 256):
                    some = [(a, b) for a, b in zip(begins, ends)][at : at + 256]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([text[a : b + reach] for a, b in some], pa.string()), pa.array([b - a for a, b in some], pa.int32()), pa.array([b == len(text) for a, b in some], pa.bool_()), pa.array([word_begins(text, a) for a, b in some], pa.bool_())], ["key", "k", "part", "n", "last", "aligned"])

    return run


def chunks_of(text: str, chunk: int, reach: int):
    """(k, part, off, n, aligned, closed) of the chunks of a normalized text, with reach characters on both sides."""
    begin = 0
    for k, end in enumerate(cut_points(text, chunk)):
        left = max(0, begin - reach)
        yield k, text[left : end + reach], begin - left, end - begin, word_begins(text, begin), end == len(text) or word_begins(text, end)
        begin = end


def _split_merges(chunk: int, reach: int):
    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for row in chunks_of(normalized(text), chunk, reach):
                    rows.append((key, *row))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _CHUNK_NAMES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _CHUNK_NAMES)

    return run


_CHUNK_NAMES = ["key", "k", "part", "off", "n", "aligned", "closed"]
_CHUNKS = "key long, k long, part string, off int, n int, aligned boolean, closed boolean"


def _transfers(model: bytes):
    def run(batches):
        import pyarrow as pa

        merges = encoder(model)
        for batch in batches:
            ms = [merges.transfer(*row) for row in zip(*(batch.column(c).to_pylist() for c in _CHUNK_NAMES[2:]))]
            raw = [np.array([[*e, *x] for e, x in m], np.int16).tobytes() for m in ms]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(raw, pa.binary())], ["key", "k", "m"])

    return run


def _scan_merges(table):
    import pyarrow as pa

    table = table.sort_by("k")
    ms = [{((a, b), (c, d)): 0.0 for a, b, c, d in np.frombuffer(x, np.int16).reshape(-1, 4).tolist()} for x in table.column("m").to_pylist()]
    flat = [(*e, *x) for e, x in boundary_pieces(ms)]
    return pa.table([table.column("key"), table.column("k"), *(pa.array(c, pa.int32()) for c in zip(*flat))], ["key", "k", "ea", "eb", "xa", "xb"])


def _trace_merges(model: bytes):
    def run(batches):
        import pyarrow as pa

        merges = encoder(model)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in [*_CHUNK_NAMES[2:], "ea", "eb", "xa", "xb"]))
            ids = [merges.trace(*row, (a, b), (c, d)) for *row, a, b, c, d in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["key", "k", "ids"])

    return run


def _matrices(model: bytes):
    def run(batches):
        import pyarrow as pa

        pieces = load(model)
        for batch in batches:
            ms = [pieces.matrix(*row).tobytes() for row in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "last", "aligned")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ms, pa.binary())], ["key", "k", "m"])

    return run


def _scan(size: int):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("k")
        ms = [np.frombuffer(b, np.float64).reshape(size, size) for b in table.column("m").to_pylist()]
        states = boundary_states(ms)
        return pa.table([table.column("key"), table.column("k"), pa.array([s[0] for s in states], pa.int32()), pa.array([s[1] for s in states], pa.int32())], ["key", "k", "entry", "exit"])

    return run


def _trace(model: bytes):
    def run(batches):
        import pyarrow as pa

        pieces = load(model)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "n", "entry", "exit")))
            ids = [pieces.best(t, a, n + b) for t, n, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["key", "k", "ids"])

    return run


def _encode(model: bytes, back: bool = False):
    """(key columns.., text) -> (key columns.., ids), with back also what the ids decode to, in the same worker."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = encoder(model)
        try:
            for batch in batches:
                texts = batch.columns[-1]
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))])
                for a, b in slices_by_bytes(ends, _SLICE):
                    raw = pieces.encode_all([t or "" for t in texts[a:b].to_pylist()])
                    offsets = np.zeros(len(raw) + 1, np.int32)
                    np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                    texts_back = [pa.array([pieces.decode(np.frombuffer(r, "<i4").tolist()) for r in raw], pa.string())] if back else []
                    yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:-1]), ids, *texts_back], [*batch.schema.names[:-1], "ids", *["text"] * back])
        finally:
            pieces.forget()  # a worker that waits for other work keeps no words

    return run


def encode(docs: DataFrame, model: bytes | None = None, giant: int = GIANT, chunk: int = CHUNK, back: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: the model's own encoding of each whole text (BPE merges, or the best segmentation).

    Null and empty texts have no ids. Characters without a piece become their bytes' pieces.
    Among segmentations of equal score that with the longest last piece, and so on backwards, is
    taken. Rows that repeat stay apart, with equal ids; null doc_ids stay; other columns are
    ignored, whatever their names; an empty table gives an empty result. With back there is a
    column text, as decode gives it.
    """
    model = model_bytes() if model is None else model
    size = load(model).longest
    if chunk < size:
        raise ValueError(f"chunks must have {size} characters at least")
    prefer_small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_giant = F.coalesce(F.char_length("text"), F.lit(0)) > giant
    small = d.where(~is_giant).mapInArrow(trimmed(_encode(model, back)), "doc_id long, ids array<int>" + ", text string" * back)
    big = materialize(d.where(is_giant).withColumn("key", F.monotonically_increasing_id()), "giants")
    total = big.agg(F.sum(F.char_length("text").cast("long"))).first()[0]
    if not total:
        return small
    # Dealt out anew to a number of partitions of its own, so that one text's chunks are many tasks' work.
    n = -(-total // _DEALT)
    texts = big.select("key", "text")
    if is_bpe(model):
        parts = materialize(texts.mapInArrow(trimmed(_split_merges(chunk, size)), _CHUNKS).repartition(n, "key", "k"), "chunks")
        ms = parts.repartition(n, "key", "k").mapInArrow(trimmed(_transfers(model)), "key long, k long, m binary")
        states = ms.groupBy("key").applyInArrow(_scan_merges, "key long, k long, ea int, eb int, xa int, xb int")
        traced = parts.join(states, ["key", "k"]).repartition(n, "key", "k").select(*_CHUNK_NAMES, "ea", "eb", "xa", "xb").mapInArrow(trimmed(_trace_merges(model)), "key long, k long, ids array<int>")
        return small.unionByName(decode(_joined(big, traced), model) if back else _joined(big, traced))
    parts = texts.mapInArrow(trimmed(_split(model, chunk)), "key long, k long, part string, n int, last boolean, aligned boolean")
    parts = materialize(parts.repartition(n, "key", "k"), "chunks")
    ms = parts.repartition(n, "key", "k").mapInArrow(trimmed(_matrices(model)), "key long, k long, m binary")
    states = ms.groupBy("key").applyInArrow(_scan(size), "key long, k long, entry int, exit int")
    traced = parts.join(states, ["key", "k"]).repartition(n, "key", "k").select("key", "k", "part", "n", "entry", "exit").mapInArrow(trimmed(_trace(model)), "key long, k long, ids array<int>")
    return small.unionByName(decode(_joined(big, traced), model) if back else _joined(big, traced))


def _joined(big: DataFrame, traced: DataFrame) -> DataFrame:
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return big.select("key", "doc_id").join(whole, "key").select("doc_id", "ids")


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """encoded(doc_id, ids) with the text of the ids; null ids have a null text, no ids an empty one.

    The mark U+2581 comes back as a space; every other text comes back as it was. Bytes that are
    no UTF-8, unknown ids' pieces and control pieces come back as the library gives them. Rows
    that repeat stay apart; other columns are ignored; an empty table stays empty.
    """
    model = model_bytes() if model is None else model

    def run(batches):
        import pyarrow as pa

        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else pieces.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
