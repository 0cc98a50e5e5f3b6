"""Archives, vectors, classifiers, mixing and the pipeline on small fixtures."""

import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, mixing, quality, toxicity, warc
from tessera.llm.labelled import held_out
from tessera.llm.support import shared_folder

DATA = "/root/testdata"
PAGES = [(2, "u\r\nv", None), (1, "u", "y" * 100), (3, None, "y" * 100), (3, "w", "y" * 100), (None, "n", "y" * 100), (None, "n", "z" * 100), (4, "q", "é" * 60), (5, "q", "é" * 60), (6, "s", "short"), (7, "s", "short")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    folder = f"{shared_folder(spark)}/warc"
    files = warc.write_warc(pages, folder)
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    expected = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        revisit = h in first and i != first[h]
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert sorted(map(str, (tuple(r) for r in warc.archived(spark, folder, files).collect()))) == sorted(map(str, expected))
    only = warc.read_warc(spark, folder, files=files).where("record_type = 'revisit' AND page_id IN (3, 5)").select("page_id", "payload").collect()
    assert sorted(r["page_id"] for r in only) == [3, 3, 5] and all(r["payload"] is None for r in only)
    assert warc.read_warc(spark, folder, payload=False).where("payload IS NOT NULL").count() == 0
    assert all(gzip.open(os.path.join(folder.removeprefix("file://"), f)).read(8) == b"WARC/1.1" for f in files)


def test_warc_of_others(spark, tmp_path):
    """Plain archives, and members without lengths."""
    records = [warc.record("response", [("WARC-Page-ID", str(i)), ("X-Folded", "a\r\n b")], b"q" * (i * 1_500_000)) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = warc.read_warc(spark, f"file://{tmp_path}").selectExpr("page_id", "octet_length(payload) AS n").collect()
    assert sorted((r["page_id"], r["n"]) for r in rows) == sorted([(i, i * 1_500_000) for i in range(3)] * 2)


def test_warc_of_nothing(spark):
    folder = f"{shared_folder(spark)}/warc"
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder) == []
    assert warc.archived(spark, folder, []).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000, rows[7][1]), (1020, None), (1040, []), (1060, [0.0] * 16), (1080, [float("nan")] * 16), (1100, [None] * 16), (None, rows[0][1]), (1120, [1.0] * 8), (1121, [2.0] * 8)]
    found = ann.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int"), k=5, every=20).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    expected = []
    for q, x in good.items():
        if q % 20 == 0:
            scores = sorted(((-float(np.cumsum(x * y)[-1]), i) for i, y in good.items() if i != q and len(y) == len(x)))[:5]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, found)) == sorted(expected)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_bounded():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((5, 64))
    mean = x.mean(0)
    about, spread = ann.estimate(*ann.encode(x, mean), q, mean)
    off = np.abs(about - q @ x.T) / spread
    assert (off < 4).mean() > 0.999 and abs((about - q @ x.T).mean()) < 0.05


WORDS = "the of and plain quiet river stone cloud walk green table lamp".split()


def labelled(spark, n=400):
    """Every third text has an insult, some of them gapped; every fourth is junk."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = [WORDS[j] for j in rng.integers(0, len(WORDS), 30)]
        if i % 3 == 0:
            words[5], words[9] = ("idiot", "scumbag") if i % 2 else ("idi-ot", "s c u m b a g")
        if i % 4 == 0:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 != 0), int(i % 3 == 0), 1))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "an idiot and a scumbag", "x")]
    labels += [(n + 5, 1, 1, 1), (None, 1, 1, 1), (0, None, None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 403 and 40 < len(held) < 120
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held if r["doc_id"] < 400) / sum(r["doc_id"] < 400 for r in held) > 0.95
    by = {r["doc_id"]: r for r in rows}
    assert by[400]["score"] == by[401]["score"] < 0.5 and by[None]["predicted"] == 1 and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_inserted_letters(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    texts = [b"a quiet river", b"you idxiot there", b"i.d.i.o.t", b"plain i d i o t walk"]
    off = np.cumsum([0, *map(len, texts)])
    shown = model.documents(toxicity.Stream(np.frombuffer(b"".join(texts), np.uint8), off), 4)[:, 0]
    assert shown[0] < min(shown[1:])


def plain_subsequences(word):
    """Code and weight of each subsequence of a word's symbols, by loops over their places."""
    out = {}
    for a in range(len(word)):
        for b in range(a + 1, len(word)):
            for c in range(b + 1, len(word)):
                if c - a <= 4:
                    out.setdefault((word[a], word[b], word[c]), []).append(toxicity.DECAY ** (c - a))
        for skipped in (None, 1, 2, 3, 4):
            places = [a + p for p in range(6 if skipped else 5) if p != skipped]
            if places[-1] < len(word):
                out.setdefault(tuple(word[p] for p in places), []).append(toxicity.DECAY if skipped else 1.0)
    return out


def test_subsequence_kernel():
    """The kernel, its norm and the folded weights against their definitions."""
    words = [bytes([0, *(c - 96 for c in w)]) for w in (b"idiot", b"idxiot", b"ox", b"meadows", b"banana")]
    plain = [plain_subsequences(w) for w in words]
    for w, p in zip(words, plain):
        assert toxicity._norms(np.array([len(w)]))[0] ** 2 == pytest.approx(max(1e-12, sum(x * x for xs in p.values() for x in xs)))
    phi, codes = toxicity._features(words, None)
    kernel = [[sum(sum(x[k]) * sum(y[k]) for k in x.keys() & y.keys()) for y in plain] for x in plain]
    norms = toxicity._norms(np.array([len(w) for w in words]))
    assert phi @ phi.T == pytest.approx(np.array(kernel) / norms[:, None] / norms)
    weights = np.random.default_rng(1).normal(size=len(codes))
    table = np.zeros(toxicity.WEIGHTS, np.float32)
    table[codes] = weights
    model = toxicity.Model(table, 0.25, np.zeros(4))
    assert model.words(toxicity._stream_of(words)) == pytest.approx(phi @ weights + 0.25, abs=1e-5)


def test_nystroem_map():
    """On the landmarks the map's inner products are the kernel."""
    words = [bytes([0, *(c - 96 for c in w)]) for w in (b"river", b"stones", b"cloudy", b"lantern")]
    phi, _ = toxicity._features(words, None)
    value, vector = np.linalg.eigh(phi @ phi.T)
    z = phi @ phi.T @ (vector @ np.diag(1 / np.sqrt(value)) @ vector.T)
    assert z @ z.T == pytest.approx(phi @ phi.T)


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality.score_quality(docs, labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_without_labels(spark, score):
    docs, labels = labelled(spark, 8)
    assert len({r["score"] for r in score(docs, labels.where("false")).collect()}) == 1
    assert score(docs.where("false"), labels).count() == 0


def test_quality_looks_at_metadata(spark):
    """A number beside the text tells the labels apart; null is a feature of its own."""
    rows = [(i, "same words here", float(i % 3 == 0) * 100 if i % 2 else (None if i % 3 else 100.0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels, metadata=["size"]).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 3 == 0) for r in out)
    assert len({r["score"] for r in quality.score_quality(docs, labels).collect()}) == 1


def test_factorisation_identity():
    """The linear-time form equals the sum over pairs."""
    rng = np.random.default_rng(2)
    m = quality.Machine(0.1, rng.normal(size=9), rng.normal(size=(9, 3)), np.zeros((0, 0)), np.zeros(0), np.ones(0))
    f, x = np.array([1, 4, 7, 2]), rng.normal(size=4)
    pairs = sum(m.factors[f[i]] @ m.factors[f[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.decide(np.zeros(4, int), f, x)[0][0] == pytest.approx(0.1 + m.weights[f] @ x + pairs)


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_rates_meet_targets(spark):
    """Against a dense projected-gradient fit of the same problem, and the targets themselves."""
    cells = [(100, [90.0, 10.0]), (300, [30.0, 270.0]), (600, [300.0, 300.0]), (0, [0.0, 0.0])]
    frame = spark.createDataFrame(cells, "tokens long, mass array<double>")
    rates = [r["rate"] for r in mixing.fit_rates(frame, [0.5, 0.5], budget=None, floor=0.0, steps=400).orderBy("tokens").collect()]
    mass = np.array([m for _, m in sorted(cells)])
    got = np.array(rates) @ mass
    assert got / got.sum() == pytest.approx([0.5, 0.5], abs=2e-3) and min(rates) >= 0
    up = [r["rate"] for r in mixing.fit_rates(frame, [0.9, 0.1], budget=None, floor=1.0).collect()]
    assert min(up) >= 1.0


def test_rates_meet_the_targets_of_scarce_domains(spark):
    """By default a domain with 1 % of the tokens gets its share."""
    shares = [0.2, 0.4, 0.2, 0.2]
    sizes = [300, 390, 300, 10]
    clear = [(n, [float(n) if i == d else 0.0 for i in range(4)]) for d, n in enumerate(sizes)]
    out = mixing.fit_rates(spark.createDataFrame(clear, "tokens long, mass array<double>"), shares, budget=None, floor=0.0)
    assert out.columns == ["tokens", "mass", "rate"]
    got = np.sum([r["rate"] * np.array(r["mass"]) for r in out.collect()], axis=0)
    assert got / 1000 == pytest.approx(shares, rel=0.01)


def test_rates_that_have_not_settled_are_reported(spark):
    frame = spark.createDataFrame([(900, [800.0, 100.0]), (100, [30.0, 70.0])], "tokens long, mass array<double>")
    with pytest.warns(RuntimeWarning, match="not settled"):
        mixing.fit_rates(frame, [0.5, 0.5], budget=None, floor=0.0, steps=1)


def test_mixing(spark):
    rows = [(i, ("le la les et " if i % 4 == 0 else "the of and to ") * 20, "n", 2.0) for i in range(80)] + [(90, None, "n", 1.0), (91, " \n", "n", 1.0), (None, "the of", "n", 1.0), (3, "the of", "n", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, rate double")
    known = spark.createDataFrame([(i, "fr" if i % 4 == 0 else "en") for i in range(40)] + [(None, "fr"), (41, None), (42, "xx")], "doc_id long, domain string")
    out = mixing.mix(docs, known, {"en": 0.5, "fr": 0.5}).collect()
    assert len(out) == 84 and out[0].asDict().keys() == {"doc_id", "text", "tokens", "rate", "_mix"}
    total = np.zeros(2)
    for r in out:
        assert sum(r["_mix"]["posterior"]) == pytest.approx(1) and r["_mix"]["rate"] >= 0
        total += r["_mix"]["rate"] * r["_mix"]["tokens"] * np.array(r["_mix"]["posterior"])
    assert total / total.sum() == pytest.approx([0.5, 0.5], abs=0.02)
    assert mixing.mix(docs.where("false"), known, {"en": 0.5, "fr": 0.5}).count() == 0
    assert all(r["_mix"]["rate"] == 1 for r in mixing.mix(docs.where("text IS NULL"), known, {"en": 1.0}).collect())


def test_copies(spark):
    rows = spark.range(4000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("n")).groupBy("n").count().collect()
    counts = {r["n"]: r["count"] for r in rows}
    assert set(counts) == {1, 2} and 800 < counts[2] < 1200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline as pipeline

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, d), name)
        assert docs.columns == columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        if name == "mixing":
            assert left == ids  # no document is lost
        ids = left
    out = pipeline.tokens(spark, docs, d)
    assert out.count() == docs.count()
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
