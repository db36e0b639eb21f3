import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.functions import stats
from strandloom.operators import alleles, balance, compartments, contacts, domains, genome, loops, orderstats, pairs, rangejoin, reads, specificity, tiles
from strandloom.sources import text
from strandloom.sources.store import Scope, exists


def test_enzymes():
    assert genome.resolve_enzyme("HindIII") == ("AAGCTT", 1) and genome.resolve_enzyme("-gatc") == ("GATC", 0)
    for bad in ("", "GATC", "GA-TC-", "GA-TX", "unknown"):
        with pytest.raises(ValueError):
            genome.resolve_enzyme(bad)


def test_digest_example(spark):
    d = spark.createDataFrame([("1", "CTAGATCAATTCGATCTTAC"), ("2", "AAAA"), ("3", "")], "chrom string, seq string")
    got = [tuple(r) for r in genome.digest(d, "chrom", "MboI").orderBy("chrom", "start").collect()]
    assert got == [("1", 0, 1, 4), ("1", 1, 4, 13), ("1", 2, 13, 20), ("2", 0, 1, 4)]


def test_haplotype_sequence(spark):
    seq = "ACGT" * 50
    g = spark.createDataFrame([("1", seq)], "chrom string, seq string")
    s = spark.createDataFrame([("1", 1, "T"), ("1", 61, "G"), ("1", 120, "A"), ("1", 200, "C"), ("1", 500, "A"), ("9", 3, "A")], "chrom string, pos long, m_alt string")
    tiles = genome.haplotype_tiles(g, s, "m_alt", 60)
    want = list(seq)
    for p, b in ((1, "T"), (61, "G"), (120, "A"), (200, "C")):
        want[p - 1] = b
    lines = [r["line"] for r in genome.wrapped(tiles, 20).orderBy("line_no").collect()]
    assert "".join(lines) == "".join(want) and all(len(x) == 20 for x in lines)


def test_range_lookup_edges(spark):
    f = genome.fragments_of_sites(spark.createDataFrame([("1", 100), ("1", 250_000)], "chrom string, site long"))
    p = spark.createDataFrame([(i, "1", x) for i, x in enumerate([1, 2, 100, 101, 250_000, 250_001])], "i int, chrom1 string, pos1 long")
    got = {r["i"]: r["end"] for r in rangejoin.point_in_interval(p, f, "chrom1", "pos1", 1000, "left").collect()}
    assert got == {0: 100, 1: 100, 2: 100, 3: 250_000, 4: 250_000, 5: None}


def test_artefacts(spark):
    cases = [("1", 0, 5, "1", 16, 9, 7, 7, "DE"), ("1", 16, 5, "1", 0, 9, 7, 7, "SC"), ("1", 0, 5, "1", 0, 9, 7, 7, "UM"), ("1", 0, 9, "1", 16, 5, 7, 7, "SC"), ("1", 16, 9, "1", 0, 5, 7, 7, "DE"), ("1", 0, 5, "1", 16, 505, 1, 2, "ED"), ("1", 0, 5, "1", 16, 506, 1, 2, "VALID"), ("1", 16, 9, "1", 0, 5, 1, 2, "ED"), ("1", 0, 5, "2", 16, 9, 7, 7, "VALID"), ("1", 0, 5, "1", 16, 5, 7, 7, "SC")]
    d = spark.createDataFrame(cases, "chrom1 string, flag1 int, pos1 long, chrom2 string, flag2 int, pos2 long, frag1 long, frag2 long, want string")
    assert d.withColumn("got", pairs.artefact_class()).where("got <> want").count() == 0


def test_dedup_is_idempotent(spark):
    d = spark.createDataFrame([("b", "1", 0, 5, "1", 16, 9), ("a", "1", 0, 5, "1", 16, 9), ("c", "1", 16, 9, "1", 0, 5)], "name string, chrom1 string, flag1 int, pos1 long, chrom2 string, flag2 int, pos2 long")
    once = pairs.drop_duplicates(d)
    assert sorted(r["name"] for r in once.collect()) == ["a", "c"] and pairs.drop_duplicates(once).count() == 2


def group(name, *rows):
    """rows: (tag, frag, bad) with bad 0 fine, 1 ambiguous, 2 unmapped."""
    return [(name, t, "1", 0, 10 * i, n, 0, 0 if b == 1 else None, int(b == 2), f, 0) for i, (t, f, b, n) in enumerate(r if len(r) == 4 else (*r, 60) for r in rows)]


def test_read_groups(spark):
    data = (
        group("two", ("1", 1, 0), ("2", 2, 0)) + group("lost", ("1", 1, 2), ("2", 2, 1)) + group("multi", ("1", 1, 0), ("2", 2, 1)) + group("one", ("1", 1, 0))
        + group("r1a", ("1", 0, 0), ("11", 1, 0), ("12", 2, 0), ("2", 2, 0)) + group("r1b", ("1", 0, 0), ("11", 1, 0), ("12", 1, 0), ("2", 2, 0)) + group("r1c", ("1", 0, 0), ("11", 1, 0), ("12", 2, 0), ("2", 3, 0))
        + group("r1d", ("1", 0, 0), ("11", 1, 1), ("12", 2, 0), ("2", 2, 0)) + group("r2a", ("1", 1, 0), ("2", 0, 0), ("21", 2, 0), ("22", 1, 0)) + group("long", ("1", 1, 0, 150), ("1", 2, 0), ("2", 3, 0, 150), ("2", 4, 0))
        + group("six", ("1", 0, 0), ("2", 0, 0), ("11", 1, 0), ("12", 2, 0), ("21", 3, 0), ("22", 2, 0)) + group("sixbad", ("1", 0, 0), ("2", 0, 0), ("11", 1, 1), ("12", 2, 0), ("21", 3, 1), ("22", 4, 0))
    )
    a = spark.createDataFrame(data, "name string, tag string, ref string, flag int, pos long, len int, as_score int, xs_score int, unmapped int, frag long, snp_n int")
    got = {(r["name"], r["outcome"]): (r["r1"] and r["r1"]["frag"], r["r2"] and r["r2"]["frag"], r["cand"] and r["cand"]["frag"], r["cand_of"]) for r in reads.integrate(a).collect()}
    none = (None, None, None, None)
    assert got == {
        ("two", "pair"): (1, 2, None, None), ("lost", "unmapped"): none, ("multi", "multiple"): none, ("one", "malformed"): none,
        ("r1a", "pair"): (1, 2, 2, "R2"), ("r1b", "pair"): (1, 2, 1, "R1"), ("r1c_1", "pair"): (1, 2, None, None), ("r1c_2", "pair"): (2, 3, None, None), ("r1d", "unmapped"): none,
        ("r2a", "pair"): (1, 2, 1, "R1"), ("long", "pair"): (2, 4, None, None), ("six_1", "pair"): (1, 2, 2, "R2"), ("six_2", "pair"): (2, 3, 2, "R1"), ("sixbad", "pair"): (2, 4, None, None),
    }


def test_allele_marks_are_symmetric(spark):
    rnd = random.Random(2)
    rows = [("1", rnd.randrange(20), rnd.randrange(-40, 0), rnd.randrange(6), rnd.choice("12"), rnd.randrange(20), rnd.randrange(-40, 0), rnd.randrange(6)) for _ in range(300)]
    d = spark.createDataFrame(rows, "mc string, mp long, ms long, mn long, pc string, pp long, ps long, pn long")
    side = lambda s: {"chrom": F.col(s + "c"), "pos": F.col(s + "p"), "score": F.col(s + "s"), "snp": F.col(s + "n")}
    d = d.select(alleles.allele_mark(side("m"), side("p")).alias("a"), F.translate(alleles.allele_mark(side("p"), side("m")), "MP", "PM").alias("b"))
    assert d.where("a <> b").count() == 0


def dense(d, n):
    out = np.zeros((n, n))
    for r in d.collect():
        out[r["bin1"], r["bin2"]] = r["value"]
    return out


def frame(spark, a):
    return spark.createDataFrame([("1", int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "chrom string, bin1 long, bin2 long, value double")


def sizes(spark, n):
    return spark.createDataFrame([("1", n)], "chrom string, n long")


def test_correction_keeps_mean_and_symmetry(spark):
    rng = np.random.default_rng(1)
    t, m, p = (rng.poisson(2.0, (24, 24)).astype(float) for _ in range(3))
    t = t + t.T
    cm, cp = balance.two_step_local(frame(spark, t), frame(spark, m), frame(spark, p), sizes(spark, 24))
    for raw, c in ((m, cm), (p, cp)):
        c = dense(c, 24)
        assert np.allclose(c, c.T) and abs(c.sum() - raw.sum()) < 1e-6


def test_ice_balances_rows(spark):
    rng = np.random.default_rng(2)
    w = rng.uniform(0.3, 3, 20)
    a = np.outer(w, w) * rng.uniform(0.9, 1.1, (20, 20))
    a = a + a.T
    bias = balance.ice_weights(frame(spark, a), 60, 1e-8)
    c = dense(balance.apply_bias(frame(spark, a), bias), 20)
    np.fill_diagonal(c, 0)
    assert np.allclose(c.sum(1), 1, atol=1e-3)


def test_distance_decay_counts_zeros(spark):
    rng = np.random.default_rng(3)
    a = rng.poisson(0.6, (15, 15)).astype(float)
    a = a + a.T
    gaps = spark.createDataFrame([("1", 4), ("1", 14)], "chrom string, bin long")
    got = {r["d"]: r["expected"] for r in compartments.distance_decay(frame(spark, a), sizes(spark, 15), gaps).collect()}
    for d in range(15):
        cells = [a[i, j] for i in range(15) for j in range(15) if abs(i - j) == d and j not in (4, 14)]
        assert got[d] == pytest.approx(np.mean(cells) if cells else 0)


def blocks_of(spark, a, size):
    """Tiles (i <= j) of a dense symmetric matrix, block vectors and their entries."""
    n = len(a)
    cells = spark.createDataFrame([("1", i, j, float(a[i, j])) for i in range(n) for j in range(n) if i // size <= j // size], "chrom string, bin1 long, bin2 long, value double")
    return tiles.tiles_of(cells, size)


def test_component_by_reach(spark):
    """A local block with strong correlations loses to a genome-wide pattern: signs must reach over half of the bins."""
    n, size = 40, 16
    wide, local = np.where(np.arange(n) // 5 % 2 == 0, 1.0, -1.0), np.where(np.arange(n) < 8, 1.0, -1.0)
    corr = blocks_of(spark, np.clip(0.6 * np.outer(wide, wide), -0.99, 0.99), size)

    def choose(*pcs):
        names = [f"pc{k + 1}" for k in range(len(pcs))]
        v = spark.createDataFrame([("1", i, *(float(p[i]) for p in pcs)) for i in range(n)], "chrom string, bin long, " + ", ".join(f"{x} double" for x in names))
        entries = v.select("chrom", "bin", F.posexplode(F.array(*names)).alias("k", "value")).selectExpr("chrom", "bin", "k + 1 as component", "value")
        r = compartments.choose_components(corr, tiles.column_blocks(v, names, size), entries, size).collect()[0]
        return r["component"], r["score"]

    assert choose(local, wide) == (2, pytest.approx(1.2))
    assert choose(local) == (1, 0.0)  # none: marked by its score
    assert choose(np.zeros(n)) == (1, 0.0)


def test_tile_products_are_numpys(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(70, 70)) * (rng.random((70, 70)) < 0.3)
    t = tiles.tiles_of(frame(spark, a), 16)
    got = dense(tiles.cells_of(tiles.gram(t, 16), 16, mirrored=True), 80)
    assert np.allclose(got[:70, :70], a.T @ a) and not got[70:].any()
    run, tiles.RUN = tiles.RUN, 2  # products of several runs are added up
    try:
        assert np.allclose(dense(tiles.cells_of(tiles.gram(t, 16), 16, mirrored=True), 80), got)
    finally:
        tiles.RUN = run


def test_principal_axes_over_tiles(spark):
    """Iterated axes of a chromosome of many tiles, with unused bins, are those of the dense matrix; so are those of one tile."""
    n, rng = 150, np.random.default_rng(9)
    used = np.array([i for i in range(n) if i % 7 != 3])
    x = rng.normal(size=(60, n)) + 2 * np.outer(rng.normal(size=60), np.sin(np.arange(n) / 9)) + np.outer(rng.normal(size=60), np.cos(np.arange(n) / 4))
    c = np.zeros((n, n))
    c[np.ix_(used, used)] = np.corrcoef(x[:, used], rowvar=False)
    u = spark.createDataFrame([("1", int(i)) for i in used], "chrom string, bin long")
    a = c[np.ix_(used, used)]
    want = np.linalg.svd(a - a.mean(0))[2][:3]
    for size in (16, 160):
        with Scope(spark) as scope:
            axes = tiles.principal_axes(scope.stored(blocks_of(spark, c, size), "c"), u, 3, scope, size, columns=8)
            rows = {r["bin"]: [r["a"], r["b"], r["c"]] for r in tiles.block_cells(axes, ["a", "b", "c"], size).collect()}
        v = np.array([rows[i] for i in range(n)])
        assert not v[[i for i in range(n) if i not in set(used)]].any()
        for k in range(3):
            assert abs(abs(v[used, k] @ want[k]) - 1) < 1e-7
    assert not exists(spark, scope.path)


def test_compartments_against_numpy(spark):
    """Axes, choice and sign of a planted second component, from the dense matrix."""
    n, rnd = 36, np.random.default_rng(5)
    wide = np.where(np.arange(n) // 4 % 2 == 0, 1.0, -1.0)
    strong = np.where(np.arange(n) < 9, 1.0, -1.0)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    a = 60 / (1 + d) * (1 + 0.55 * np.outer(strong, strong) + 0.35 * np.outer(wide, wide)) + rnd.random((n, n)) * 0.2
    a = np.triu(a) + np.triu(a, 1).T
    got, again = (sorted(compartments.call_compartments(frame(spark, a), sizes(spark, n), size=size).collect(), key=lambda r: r["bin"]) for size in (tiles.TILE, 8))
    assert all(x["component"] == y["component"] and np.allclose(list(x)[2:], list(y)[2:], atol=1e-6) for x, y in zip(got, again))
    expected = np.array([np.mean(np.diagonal(a, k)) for k in range(n)])
    r = np.nan_to_num(np.corrcoef(a / expected[d], rowvar=False))
    axes = np.linalg.eigh(np.cov(r, rowvar=False))[1][:, ::-1][:, :3]
    for k in range(3):
        mine = np.array([x[f"pc{k + 1}"] for x in got])
        assert np.linalg.norm(mine) == pytest.approx(1) and abs(mine @ axes[:, k]) == pytest.approx(1, abs=1e-6)
    scores = []
    for k in range(3):
        up, down = [i for i in range(n) if axes[i, k] > 0], [i for i in range(n) if axes[i, k] < 0]
        reach = lambda x: max(x) - min(x)
        same = [r[i, j] for x in (up, down) for i in x for j in x if -1 < r[i, j] < 1 - 1e-5]
        cross = [r[i, j] for i in up for j in down]
        scores.append(np.mean(same) - np.mean(cross) if min(reach(up), reach(down)) > (n - 1) / 2 else 0)
    assert got[0]["component"] == int(np.argmax(scores)) + 1 == 2 and got[0]["score"] == pytest.approx(max(scores), abs=1e-6)
    assert abs(np.corrcoef([x["pc"] for x in got], wide)[0, 1]) > 0.9


def test_loop_background(spark):
    """Zero parents and means above the 95th percentile are left out; shares and ranks are those of the rest and of all."""
    import math

    from strandloom.operators import specificity

    rnd = np.random.default_rng(2)
    m, p = rnd.integers(0, 90, 60).astype(float), rnd.integers(0, 90, 60).astype(float)
    m[:3], p[3:6], m[6], p[6] = 0, 0, 500, 700
    table = lambda v: spark.createDataFrame([("1", 0, i, float(x)) for i, x in enumerate(v) if x], "chrom string, bin1 long, bin2 long, value double")
    loops_ = spark.createDataFrame([("1", 0, i, 0, i) for i in range(60)], "chrom string, m1 long, m2 long, p1 long, p2 long")
    for legacy in (False, True):
        got = {r["m2"]: r for r in specificity.loop_specificity(loops_, table(m), table(p), legacy).collect()}
        means = sorted(x for x in (m + p) // 2 if x)
        most = np.percentile(range(len(means)) if legacy else means, 95)
        use = [i for i in range(60) if m[i] and p[i] and (m[i] + p[i]) / 2 <= most]
        assert sorted(got) == use and 6 not in use
        p0 = sum(m[i] for i in use) / sum(m[i] + p[i] for i in use)
        for i in use:
            t = m[i] + p[i]
            if min(p0 * t, (1 - p0) * t) < 5:
                assert got[i]["z"] is None and got[i]["rank_ratio"] is None and got[i]["log2fc"] is None
            else:
                assert got[i]["rank_ratio"] == pytest.approx(sum(x < t // 2 for x in means) / len(means)) and got[i]["log2fc"] == pytest.approx(math.log2(m[i] / p[i]))
                sd = math.sqrt(t * p0 * (1 - p0))
                assert got[i]["z"] == pytest.approx((m[i] - t * p0) / sd if min(p0 * t, (1 - p0) * t) >= 30 else (abs(m[i] - t * p0) - 0.5) / sd)


def test_compartments_of_a_checkerboard(spark):
    rng = np.random.default_rng(4)
    n = 40
    side = np.where((np.arange(n) // 5) % 2 == 0, 1, -1)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    a = rng.poisson(60 / (1 + d) * np.where(np.equal.outer(side, side), 1.6, 0.5) + 1).astype(float)
    a = np.triu(a) + np.triu(a, 1).T
    pc = {r["bin"]: r["pc"] for r in compartments.call_compartments(frame(spark, a), sizes(spark, n)).collect()}
    assert abs(np.corrcoef(np.sign([pc[i] for i in range(n)]), side)[0, 1]) > 0.9


def test_domains_of_blocks(spark):
    x = np.concatenate([np.full(8, 4.0), np.full(4, 0.0), np.full(8, -4.0)] * 6) + np.random.default_rng(5).normal(0, 0.3, 120)
    model = domains.MixtureHMM.prior(3)
    for _ in range(3):
        model = model.update(model.expect(x))
    path = model.viterbi(x)
    # Down-, no and upstream bins follow each other as planted.
    assert np.mean(path[x > 2] == 0) > 0.9 and np.mean(path[x < -2] == 2) > 0.9
    with pytest.raises(ValueError):
        domains.MixtureHMM.prior(6)


def test_window_sums():
    rng = np.random.default_rng(6)
    a = rng.random((30, 30))
    i, j = np.array([0, 4, 10, 29]), np.array([3, 20, 15, 29])
    for w, pw in ((3, 1), (5, 2)):
        donut, lower = loops.window_sums(a, i, j, w, pw)
        for k in range(len(i)):
            d = low = 0.0
            for x in range(-w, w + 1):
                for y in range(-w, w + 1):
                    if x and y and not (abs(x) <= pw and abs(y) <= pw) and 0 <= i[k] + x < 30 and 0 <= j[k] + y < 30:
                        d += a[i[k] + x, j[k] + y]
                        low += a[i[k] + x, j[k] + y] if x >= 1 and y <= -1 and not (x <= pw and y >= -pw) else 0
            assert donut[k] == pytest.approx(d) and lower[k] == pytest.approx(low)


def test_isotonic_and_clusters():
    y = np.array([5.0, 3, 4, 2, 2.5, 1])
    f = loops.isotonic_fit(y)
    assert (np.diff(f) <= 1e-12).all() and f.sum() == pytest.approx(y.sum())
    c = loops.cluster_points(np.array([[0, 0], [1, 1], [50, 50]]), np.array([0.2, 0.1, 0.3]), np.ones(3), 5)
    assert c == [(1, 2.0), (2, 1.0)]


def test_probabilities():
    assert stats.poisson_upper(3, 2.0) == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2 + 8 / 6))
    assert stats.poisson_upper(50, 2.0) < 1e-40 and stats.poisson_upper(-1, 2.0) == 1
    assert stats.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5) and stats.incomplete_beta(2, 3, 0.3) == pytest.approx(0.3483)


def test_text_formats(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 x\nACGT\nac\n>chrX\nTT\n")
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "g.fa")).collect())) == [("1", "ACGTAC"), ("X", "TT")]
    (tmp_path / "r_chunk3.fastq").write_text("@a 1\nACGT\n+\nIIII\n@b\nTT\n+\n##\n")
    assert sorted(map(tuple, text.read_fastq(spark, str(tmp_path / "r_chunk3.fastq"), 2).collect())) == [("a_2", 2, "ACGT", "IIII", 3), ("b_2", 2, "TT", "##", 3)]
    (tmp_path / "a.sam").write_text("@HD\nr1_1\t0\tchr2\t7\t9\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:-3\tXS:i:-5\nr1_2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    got = sorted(map(tuple, text.read_sam(spark, str(tmp_path / "a.sam")).collect()))
    assert got == [("r1", "1", "2", 0, 7, 4, -3, -5, "ACGT", 0), ("r1", "2", "*", 4, 0, 2, None, None, "AC", 1)]
    (tmp_path / "p.bed").write_text("n\t1\t0\t5\t60\t-1\t7\t2\t2\t16\t9\t60\t-2\t11\t0\n" + "m\t1\t0\t5\t60\t-1\t7\t2\t2\t16\t9\t60\t-2\t11\t0\t2\t0\t4\t50\t-9\t12\t1\tR2\n")
    p = text.read_pairs(spark, str(tmp_path / "p.bed"))
    text.write_pairs(p, str(tmp_path / "out"))
    assert sorted(map(str, text.read_pairs(spark, str(tmp_path / "out")).collect())) == sorted(map(str, p.collect()))


def test_pixels_conserve_contacts(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("12"), rnd.randrange(10**6), rnd.choice("12"), rnd.randrange(10**6)) for _ in range(400)]
    d = spark.createDataFrame(rows, "chrom1 string, frag1 long, chrom2 string, frag2 long")
    for res in ([40_000, 200_000], [30_000, 70_000]):
        c = contacts.count_contacts(d, res)
        assert {r["res"]: r["s"] for r in c.groupBy("res").agg(F.sum("n").alias("s")).collect()} == dict.fromkeys(res, 400)
        assert c.where("chrom1 > chrom2 or (chrom1 = chrom2 and bin1 > bin2)").count() == 0


def test_stream(spark, tmp_path):
    from strandloom.streaming.contacts import count_stream, stream_pairs

    schema = "name string, chrom1 string, frag1 long, chrom2 string, frag2 long, ts timestamp"
    rows = [("a", "1", 5, "1", 100, "2020-01-01 00:00:00"), ("a", "1", 5, "1", 100, "2020-01-01 00:00:01"), ("b", "1", 100, "1", 7, "2020-01-01 00:00:02")]
    d = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    q = count_stream(stream_pairs(spark, str(tmp_path / "in"), schema), 50, "ts").writeStream.outputMode("update").format("memory").queryName("px").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("px").collect()] == [("1", 0, "1", 2, 2)]


def test_differences_below_by_blocks(spark):
    """Counts of differences below thresholds, ties and thresholds that are differences included, with blocks of a few values."""
    rng = np.random.default_rng(12)
    a, b = np.round(rng.normal(size=230), 2), np.round(rng.normal(size=170), 2)
    x = np.concatenate([np.round(rng.normal(size=60) * 2, 2), a[:40] - b[:40], [-99.0, 99.0]])
    column = lambda v, n: spark.createDataFrame([(float(i),) for i in v], f"{n} double").repartition(3)
    d = a[:, None] - b[None]
    for block in (7, 4096):
        with Scope(spark) as scope:
            got = {r["x"]: r["below"] for r in orderstats.differences_below(column(a, "v"), column(b, "v"), column(x, "x"), scope, block).collect()}
        assert got == {float(t): int((d < t).sum()) for t in x}


def test_compartment_specificity_against_all_pairs(spark):
    rng = np.random.default_rng(13)
    m, p = rng.normal(size=(2, 80)), rng.normal(size=(2, 80))
    p[0] = 0.6 * m[0] + 0.5 * p[0]
    p[1] = -0.6 * m[1] + 0.5 * p[1]  # flipped
    table = lambda v: spark.createDataFrame([(str(c), i, float(v[c, i])) for c in range(2) for i in range(80)], "chrom string, bin long, pc double")
    got = {(r["chrom"], r["bin"]): r for r in specificity.compartment_specificity(table(m), table(p), 9).collect()}
    m[1] = -m[1]
    use = [(c, i) for c in range(2) for i in range(80) if m[c, i] * p[c, i] < 0]
    assert sorted(got) == sorted((str(c), i) for c, i in use)
    every = np.array([m[x] for x in use])[:, None] - np.array([p[x] for x in use])[None]
    for c, i in use:
        k = int((every < m[c, i] - p[c, i]).sum())
        assert got[str(c), i]["pvalue"] == pytest.approx(min(k, every.size - k) / every.size)


def serial_clusters(points, q, reach):
    """Clusters of all of a chromosome's loops in one pass, then twice as wide until none merge."""
    n, r = np.ones(len(points)), reach
    while True:
        c = loops.cluster_points(points, q, n, r)
        k = [b for b, _ in c]
        done = r > reach and len(c) == len(points)
        points, q, n, r = points[k], q[k], np.array([x for _, x in c]), 2 * reach
        if done:
            return sorted((*map(int, p), float(x), int(y)) for p, x, y in zip(points, q, n))


def test_clusters_of_groups_are_the_serial_ones(spark):
    """Thousands of loops in dense and sparse stretches: groups apart give what one pass over a chromosome gives."""
    rng = np.random.default_rng(21)
    res, reach = 10_000, 10_000 * math.sqrt(2) + 1000
    rows = []
    for chrom in "12":
        centres = rng.integers(0, 4_000, (260, 2)) * res
        centres[:, 1] += centres[:, 0]
        p = np.unique(np.concatenate([c + rng.integers(-4, 5, (int(rng.integers(1, 14)), 2)) * res for c in centres]), axis=0)
        rows += [(chrom, int(a), int(b), float(x)) for (a, b), x in zip(p, np.round(rng.random(len(p)), 6))]
    d = spark.createDataFrame(rows, "chrom string, start long, end long, q double")
    assert len(rows) > 3000 and loops.independent_groups(d, 2 * reach).select("chrom", "group").distinct().count() > 60
    got = loops.cluster_loops(d, res).collect()
    for chrom in "12":
        mine = [r for r in rows if r[0] == chrom]
        want = serial_clusters(np.array([r[1:3] for r in mine]), np.array([r[3] for r in mine]), reach)
        assert sorted((r["start"], r["end"], r["q"], r["n"]) for r in got if r["chrom"] == chrom) == want


def test_window_sums_over_tiles(spark):
    rng = np.random.default_rng(22)
    n, w, pw, ww = 70, 5, 1, 3
    a, b = np.triu(rng.poisson(0.7, (n, n))).astype(float), np.triu(rng.poisson(0.7, (n, n))).astype(float)
    e = np.linspace(3, 1, n)
    peaks = spark.createDataFrame([("1", i, j) for i in range(n) for j in range(i, n) if (i * 7 + j) % 5 == 0], "chrom string, bin1 long, bin2 long")
    ex = spark.createDataFrame([("1", d, float(e[d])) for d in range(n)], "chrom string, d long, expected double")
    far = np.arange(n)[None] - np.arange(n)[:, None]
    s, x, r = np.where(far >= ww, a, 0), np.where(far >= ww, e[np.abs(far)], 0), b - np.diag(np.diag(b))
    for tile in (16, 512):
        got = loops.donut_sums(peaks, frame(spark, a), frame(spark, b), ex, sizes(spark, n), w, pw, ww, tile).collect()
        assert len(got) == peaks.count()
        i, j = np.array([r_["bin1"] for r_ in got]), np.array([r_["bin2"] for r_ in got])
        for m, k, y in ((s, "k_s", "y_s"), (x, "k_e", "y_e"), (r, None, "y_reads")):
            donut, lower = loops.window_sums(m, i, j, w, pw)
            assert np.allclose([g[y] for g in got], lower) and (k is None or np.allclose([g[k] for g in got], donut))


def test_box_sums_over_tiles(spark):
    rng = np.random.default_rng(23)
    a = rng.poisson(0.05, (50, 50)).astype(float)
    for step, size in ((2, 8), (3, 256)):
        got = {(r["bin1"], r["bin2"]): r["value"] for r in tiles.box_sums(frame(spark, a), step, size).where("bin1 < 50 and bin2 < 50").collect()}
        want = {(i, j): a[max(0, i - step) : i + step + 1, max(0, j - step) : j + step + 1].sum() for i in range(50) for j in range(50)}
        assert got == {k: v for k, v in want.items() if v}


def test_counters_taken_in_one_pass(spark, tmp_path):
    rnd = random.Random(5)
    row = lambda i: (f"n{i}", rnd.choice("12"), rnd.choice([0, 16]), rnd.randrange(1, 900), rnd.choice("12"), rnd.choice([0, 16]), rnd.randrange(1, 900))
    rows = [row(i) for i in range(300)]
    rows += [(f"z{i}", *r[1:]) for i, r in enumerate(rows[:80])]
    schema = "name string, chrom1 string, flag1 int, pos1 long, chrom2 string, flag2 int, pos2 long"
    d = spark.createDataFrame(rows, schema)
    f = genome.fragments_of_sites(spark.createDataFrame([(c, x) for c in "12" for x in range(100, 1000, 100)], "chrom string, site long"))
    got = pairs.write_valid_pairs(d, f, str(tmp_path / "valid"))
    assert got == pairs.filtering_stats(d, f).first().asDict()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "valid")).collect())) == sorted(map(str, pairs.valid_pairs(d, f).collect()))
    halves = [pairs.write_valid_pairs(d.where(w), f, str(tmp_path / k)) for k, w in (("a", "chrom1 = '1'"), ("b", "chrom1 = '2'"))]
    assert pairs.merged_stats(halves) == got and pairs.merged_stats([]) == {}



def test_range_lookup_reads_few_candidates_however_dense_the_intervals(spark):
    """Without a width, buckets follow the intervals: a few to a bucket, and at most two buckets an interval on average."""
    n = 20_000
    f = genome.fragments_of_sites(spark.range(1, n + 1).selectExpr("'1' as chrom", "id * 5 + id % 3 as site"))
    width = rangejoin.width_for(f)
    kept = f.select(F.explode(rangejoin.buckets_of(F.col("start"), F.col("end"), width)).alias("b")).groupBy("b").count()
    assert kept.agg(F.max("count")).first()[0] <= 6 and kept.agg(F.sum("count")).first()[0] <= 2 * n
    p = spark.range(1, 5 * n).selectExpr("'1' as chrom1", "id as pos1")
    got = rangejoin.point_in_interval(p, f, "chrom1", "pos1")
    assert got.count() == 5 * n - 1 and got.where("pos1 > end or pos1 <= start and pos1 <> 1").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "50000" not in plan
    assert rangejoin.width_for(f.limit(0)) >= 1
