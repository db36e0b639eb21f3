import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from strandloom.llm import alignment as al

PATH_A, PATH_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def tokens(text):
    """Ids and bytes of both libraries' own encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not _LIB:
        t = Tokenizer.from_file(PATH_A)
        t.encode_special_tokens = True
        _LIB.extend([t, {v: k for k, v in t.get_vocab().items()}, sentencepiece.SentencePieceProcessor(model_file=PATH_B)])
    t, inverse, sp = _LIB
    of = al._byte_of()
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("\u2581", " ").encode()
    return a, [bytes(of[c] for c in inverse[i]) for i in a], b, [piece(i) for i in b]


_LIB: list = []


def brute(texts):
    """Groups by comparing end offsets, links one by one."""
    figures, every = [], []
    for text in texts:
        a, ab, b, bb = tokens(text) if text else ([], [], [], [])
        whole = (" " + text).encode() if text else None
        if b"".join(ab) != whole or b"".join(bb) != whole:
            figures.append((0, 0, 0, 0, ""))
            every.append([])
            continue
        ends = [np.cumsum([len(x) for x in part]).tolist() for part in (ab, bb)]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links += [(x, y) for x in a[i:i2] for y in b[j:j2]]
            i, j = i2, j2
        figures.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        every.append(links)
    n, top = Counter(p for links in every for p in set(links)), defaultdict(int)
    for (x, _), k in n.items():
        top[x] = max(top[x], k)
    return [(*f[:4], sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), f[4]) for f, links in zip(figures, every)]


TEXTS = [
    "The quick brown fox, the lazy dog. The fox!", "The fox and the dog", "Straße über Größe, été où", "\u6f22\u5b57\u304b\u306a" * 40, "<|endoftext|> and <s> are text", None, "", " ", "  two  spaces ",
    "with a mark \u2581 inside", "a" * 3000, "ab" * 700 + "\U0001f642" * 30, "tab\tline\n\n end \x00 nul", "The fox and the dog", "x" * 20 + " 12345678901234567890",
]


@pytest.mark.parametrize("most", [al.BROADCAST_PAIRS, 0])
def test_rows_match_brute_force(spark, most):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, "The fox")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as n_a", "3 as code")
    got = al.align(d.repartition(3), broadcast_pairs=most).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert al.align(d.limit(0)).count() == 0


def test_groups_end_where_both_tokens_end():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(1, 40))
        a, b = (np.append(np.sort(rnd.choice(np.arange(1, n), int(rnd.integers(0, n)), replace=False)) if n > 1 else np.zeros(0, int), n).astype(int) for _ in "ab")
        ga, gb = al.groups_of(a, b)
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[ga[1:] - 1].tolist() == cuts and b[gb[1:] - 1].tolist() == cuts


def test_wide_groups_give_the_pairs_of_plain_links():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 300, 900), rnd.integers(0, 200, 700)
    ga, gb = np.array([0, 3, 800, 805, 900]), np.array([0, 2, 600, 605, 700])
    want = np.unique(al._links(a, b, ga, gb, 1000), return_counts=True)
    block, al._BLOCK = al._BLOCK, 5000
    try:
        parts = list(al.pair_blocks(a, b, ga, gb, 1000))
    finally:
        al._BLOCK = block
    assert len(parts) > 3
    assert (np.concatenate([c for c, _ in parts]) == want[0]).all() and (np.concatenate([n for _, n in parts]) == want[1]).all()


def test_packed_numbers_come_back():
    for x in ([], [0], [5, 1, 2**32 - 1, 70000], list(range(3000))):
        assert al._unpack(al._pack(np.array(x, np.int64))).tolist() == x
