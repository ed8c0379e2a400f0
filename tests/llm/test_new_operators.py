"""Phrases, signature join and clustering against brute-force versions on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, name string, a long, node long, block long, `x.y` long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(spark, pairs):
    """Documents of (doc_id, text, lang), with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, lang, "clash", 1, 2, 3, 4) for i, t, lang in pairs], DOCS).repartition(3)


# ------------------------------------------------------------ phrases


def expected_phrases(pairs, least, first):
    counts = defaultdict(Counter)
    for _, text, lang in pairs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            inside = any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in candidates.items())
            if not inside:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n, -score) for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases(spark):
    from alarmloom.llm.phrases import top_phrases

    rng = random.Random(3)
    words = ["New", "york", "city", "hall", "of", "the", "état", "Ärger", "ÉTÉ", "x", "漢字", "a\x1cb", " "]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "!? "]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    pairs = [(i, t + " new york city hall", rng.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)]
    pairs += [(None, None, "en"), (7, "", None), (8, " . ,", "fr"), (9, "alone", "it"), pairs[0], pairs[0]]
    for least, first in ((3, 2000), (2, 5)):
        assert phrase_rows(top_phrases(made(spark, pairs), least=least, first=first)) == expected_phrases(pairs, least, first)
    assert phrase_rows(top_phrases(made(spark, []))) == []
    assert phrase_rows(top_phrases(made(spark, [(1, "a b", "en")]))) == []


def test_phrases_of_a_very_long_text(spark):
    """Runs of a text end in the middle of phrases, and counts are sent in the middle of a text."""
    from alarmloom.llm.phrases import POSITIONS, top_phrases

    rng = random.Random(5)
    words = ["ab", "c", "de", "f", "gh"]
    text = " ".join(rng.choices(words, k=POSITIONS + POSITIONS // 4))
    got = phrase_rows(top_phrases(made(spark, [(1, text, "en"), (2, "c. f", "en")]), least=1000))
    parts = text.split(" ")
    for phrase in ("ab c", "de f gh", "gh gh gh gh"):
        k = phrase.count(" ") + 1
        a = sum(map((phrase.split(" ")).__eq__, (parts[i : i + k] for i in range(len(parts) - k + 1))))
        row = [r for r in got if r[2] == phrase]
        assert [r[3] for r in row] == [a] and row[0][6] == len(parts) + 2


def test_scores_beyond_64_bits(spark):
    from alarmloom.llm.phrases import score

    row = (9_000_000_000_000_000, 9_100_000_000_000_000, 9_200_000_000_000_001)
    df = spark.createDataFrame([row], "a long, l long, r long").select(score("a", "l", "r").alias("s"))
    assert df.first().s == 2_000_000 * row[0] // (row[1] + row[2])


# ------------------------------------------------------------ signature join


def word_sets(pairs):
    out = []
    for _, text, _ in pairs:
        words = re.findall("[^ \t-\r]+", (text or "").translate(LOWER))
        out.append(frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)]) if words else frozenset())
    return out


def expected_components(pairs):
    sets = word_sets(pairs)
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(pairs):
        least[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _, _) in enumerate(pairs):
        component = min((x for x in least[find(i)] if x is not None), default=None)
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def changed(rng, words, share):
    return [rng.choice(["zz%d" % rng.randint(0, 10**6), w]) if rng.random() < share else w for w in words]


def near_texts():
    """Groups of copies at all distances around the threshold, one with very many, ties at exactly 80 per cent, odd texts."""
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(60)]
    texts = []
    for share in (0.0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2):
        base = rng.choices(vocabulary, k=rng.choice([20, 60, 200]))
        texts += [" ".join(changed(rng, base, share)) for _ in range(12)]
    base = rng.choices(vocabulary, k=80)
    texts += [" ".join(changed(rng, base, 0.06)) for _ in range(70)]
    texts += [" ".join("t%d" % i for i in range(n)) for n in (9, 11, 5, 6, 50)]  # sets of 8 and 10, 4 and 5
    texts += ["word", "Word", "word word", "other", "", None, " \n", "a b", "A  b\t", "a b a b a b"]
    texts += ["Σ漢 é ü", "Σ漢 É ü", "x" * 100_000, "y " * 30_000 + "end"]
    return texts


def report(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_signature_join(spark):
    from alarmloom.llm.minhash import component_report

    rng = random.Random(2)
    texts = near_texts()
    ids = rng.sample(range(10_000), len(texts))
    pairs = [(i, t, "en") for i, t in zip(ids, texts)]
    pairs += [pairs[0], pairs[0], (None, "no id at all", None), (None, "no ID at all", None), (None, texts[1], None)]
    expected = [(a, b, c, True if a is None and c is None else d) for a, b, c, d in expected_components(pairs)]
    assert report(component_report(made(spark, pairs))) == sorted(expected, key=repr)
    # short lists are cut into blocks, so that trees, open candidates and blocks against blocks all take part
    assert report(component_report(made(spark, pairs), block=4)) == sorted(expected, key=repr)
    assert report(component_report(made(spark, []))) == []
    assert report(component_report(made(spark, [(1, None, "en"), (2, "", "en")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_signature_join_moves_a_dense_group_once(spark, monkeypatch):
    """A group of near copies, many of its pairs below the threshold, in blocks of 8: joins with sets and signatures make fewer rows than there are postings."""
    from alarmloom.llm.minhash import COORDINATES, component_report, matches_needed

    rng = random.Random(12)
    base = rng.choices(["w%d" % i for i in range(400)], k=80)
    pairs = [(i, " ".join(changed(rng, base, 0.06)), "en") for i in range(120)]
    docs = made(spark, pairs)
    kind, made_rows = type(docs), []
    join = kind.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on == "node":
            made_rows.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", counted)
    assert report(component_report(docs, block=8)) == sorted(expected_components(pairs), key=repr)
    assert sum(made_rows) < len(pairs) * (COORDINATES - matches_needed() + 1)


def test_matches_needed_bounds_the_misses():
    from alarmloom.llm.minhash import COORDINATES, MISS, matches_needed

    t = matches_needed(80)
    chance = [sum(math.comb(COORDINATES, k) * 0.8**k * 0.2 ** (COORDINATES - k) for k in range(n)) for n in (t, t + 1)]
    assert chance[0] < MISS <= chance[1]


def test_candidate_pairs_of_runs_across_batches():
    import pyarrow as pa

    from alarmloom.llm.minhash import by_runs, candidate_pairs

    rng = random.Random(4)
    keys = sorted(rng.choices(range(30), k=300))
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 7], pa.int64()), "at": pa.array(range(i, min(300, i + 7)), pa.int64())}) for i in range(0, 300, 7)]
    got = set()
    for table, run in by_runs(iter(batches), ["k"]):
        at, marks = table.column("at").to_numpy(), np.zeros((len(run), 32), np.uint8)
        i, j = candidate_pairs(run, marks, np.ones(len(run), np.int64), 12, 80)
        got |= set(zip(at[i].tolist(), at[j].tolist()))
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] == keys[j]}


# ------------------------------------------------------------ clustering


def expected_clusters(rows, count, rounds, dimensions):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(1024 * x) for x in e]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:count]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        best = nearest()
        for k in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, best) if c == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    best = nearest()
    top = (1 << 63) - 1
    distances = [min(d, top) for d, _ in best]
    within = [min(top, sum(d for d, (_, c) in zip(distances, best) if c == k)) for k in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, within[c], min(top, sum(distances)), digests[c]) for (i, _), d, (_, c) in zip(kept, distances, best)), key=repr)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e, "clash", 1.0) for i, e in rows], f"vec_id long, embedding array<{kind}>, cluster string, upper double").repartition(3)


def clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("scale", [0.002, 1.0])
def test_clusters(spark, scale):
    """Small scales make most distances ties."""
    from alarmloom.llm.clustering import cluster_vectors

    rng = random.Random(6)
    rows = [(i, [float(np.float32(scale * rng.gauss(i % 5, 1.0))) for _ in range(4)]) for i in range(300)]
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [math.nan] * 4), (903, [math.inf, 0.0, 0.0, 0.0]), (904, [1.0] * 3), (905, []), (None, [0.5] * 4), rows[0], rows[0]]
    got = clusters(cluster_vectors(vectors(spark, rows), count=8, rounds=6, dimensions=4))
    assert got == expected_clusters(rows, 8, 6, 4)


def test_clusters_of_huge_few_and_no_vectors(spark):
    from alarmloom.llm.clustering import cluster_vectors

    rng = random.Random(8)
    huge = [(i, [rng.choice([1.0, -1.0]) * 10.0 ** rng.randint(-3, 37) for _ in range(4)]) for i in range(40)]
    for rows, kind in ((huge, "double"), (huge[:3], "double"), ([(1, [0.0] * 4)] * 12, "float"), ([], "float")):
        got = clusters(cluster_vectors(vectors(spark, rows, kind), count=5, rounds=4, dimensions=4))
        assert got == expected_clusters(rows, 5, 4, 4)


def test_bounds_spare_distances():
    from alarmloom.llm.clustering import Centroids, assign

    rng = np.random.default_rng(1)
    places = rng.integers(-2000, 2000, (8, 16))
    points = (places[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int64)
    centres = [list(map(int, p)) for p in points[:8]]
    own, upper, lower, before, worked = np.full(4000, -1), np.zeros(4000), np.zeros((4000, 8)), None, []
    for _ in range(8):
        own, upper, lower, n = assign(points, np.array(centres), Centroids(centres, before), own, upper, lower)
        full = ((points[:, None, :] - np.array(centres)[None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all()
        assert (upper >= np.sqrt(full[np.arange(4000), own])).all() and (lower <= np.sqrt(full)).all()
        worked.append(n)
        before, centres = centres, [list(map(int, points[own == k].sum(0) // max(1, (own == k).sum()))) if (own == k).any() else c for k, c in enumerate(centres)]
    assert worked[-1] < worked[0] / 4


# ------------------------------------------------------------ columns of any name


def odd_documents(spark):
    from pyspark.sql import functions as F

    texts = ["alpha beta gamma delta epsilon"] * 3 + ["password = hunter2hunter2 in a text", None, "", "other words here"]
    base = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    return base.select(
        "*",
        F.col("doc_id").alias("a.b"),
        F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("a`b"),
        F.struct(F.col("doc_id").alias("x.y"), F.lit(1).alias("`")).alias("nested"),
        F.create_map(F.lit("k"), F.col("doc_id")).alias("map"),
        F.array(F.struct(F.col("doc_id").alias("in.side"))).alias("c0"),
        F.col("doc_id").alias("with space"),
    )


def test_every_operator_that_keeps_columns_keeps_those_of_any_name(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from alarmloom.llm.media import thumbnails
    from alarmloom.llm.mixing import mixed_documents
    from alarmloom.llm.near_copies import drop_near_copies
    from alarmloom.llm.quality import keep_drawn
    from alarmloom.llm.secret_scan import redact, scan_secrets
    from alarmloom.llm.sharding import write_shards
    from alarmloom.llm.simhash import drop_near_duplicates
    from alarmloom.llm.token_counts import count_tokens
    from alarmloom.llm.bpe import vocabulary

    docs = odd_documents(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")

    def write(df):
        path = str(tmp_path / f"shards-{len(df.columns)}")
        write_shards(df, path, 2)
        back = spark.read.parquet(path)
        return back.select([c for c in map(lambda c: "`" + c.replace("`", "``") + "`", back.columns) if c != "`__shard`"])

    keepers = {
        "keep_drawn": lambda df: keep_drawn(df, labels),
        "redact": redact,
        "mixed_documents": mixed_documents,
        "drop_near_copies": drop_near_copies,
        "drop_near_duplicates": drop_near_duplicates,
        "write_shards": write,
        "scan_secrets": lambda df: scan_secrets(df).drop("secret_spans"),
        "thumbnails": lambda df: thumbnails(df.withColumn("media", F.lit(b"none"))).drop("media", "media_width", "media_height", "thumbnail", "thumbnail_width", "thumbnail_hash", "media_error"),
    }
    for name, keep in keepers.items():
        got, few = keep(docs), keep(plain)
        assert got.columns == docs.columns, name
        rows = [r.asDict(recursive=True) for r in got.collect()]
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r.doc_id for r in few.collect()), key=repr), name
        for r in rows:
            i = r["doc_id"]
            assert (r["a.b"], r["a`b"], r["nested"], r["map"], r["c0"], r["with space"]) == (i, None if i is None else f"x{i}", {"x.y": i, "`": 1}, {"k": i}, [{"in.side": i}], i), name
    assert sorted(r["a.b"] for r in count_tokens(docs.where("doc_id is not null"), vocabulary("word_bpe_49k.json"), keys=("a.b", "a`b")).collect()) == list(range(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, stage_docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count()


# ------------------------------------------------------------ single keys of token files


def test_one_key_reads_a_few_numbers(spark, tmp_path, monkeypatch):
    from alarmloom.llm import token_files
    from alarmloom.llm.bpe import vocabulary

    made = [(i * 7 - 3000, f"text number {i} " * (i % 5)) for i in range(6000)] + [(70, "again"), (70, "and again"), (None, "none")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    manifest = token_files.write_token_files(df, str(tmp_path / "ids"), vocabulary("byte_bpe_50k.json"))
    read = []
    numbers = token_files.Keyed.numbers
    monkeypatch.setattr(token_files.Keyed, "numbers", lambda self, at, n, kind: read.append(n * np.dtype(kind).itemsize) or numbers(self, at, n, kind))
    size = 0
    for row in manifest.where("least IS NOT NULL").collect():
        whole, keyed = token_files.Shard(row.path), token_files.Keyed(row.path)
        opening, size = sum(read), size + len(whole.slots)
        for doc_id in [row.least, row.most, 70, 4, 1001, 10**12, *range(row.least, row.least + 700, 7)]:
            read.clear()
            assert [x.tolist() for x in keyed.get(doc_id)] == [x.tolist() for x in whole.get(doc_id)]
            assert sum(read) < 2000 and opening < 5000
        read.clear()
        keyed.close()
        whole.close()
    assert size >= 6000
    assert len(token_files.lookup(manifest, 70)) == 2 and token_files.lookup(manifest, 71) == []


# ------------------------------------------------------------ the pipeline, end to end


def plain_draw(pairs, labels):
    """Documents that importance resampling keeps, in plain Python."""
    from math import log
    from struct import pack

    import xxhash

    from .test_operators import plain_features

    good = {i for i, q in labels if q == 1}
    raw, target = Counter(), Counter()
    for doc_id, text in pairs:
        features = plain_features(text or "")
        raw.update(features)
        target.update(features if doc_id in good else ())
    ratio = {}
    for part in (range(1 << 16), range(1 << 16, 1 << 17)):
        all_raw, all_target = sum(v for b, v in raw.items() if b in part), sum(v for b, v in target.items() if b in part)
        for b in (b for b in raw if b in part):
            share = raw[b] / all_raw
            ratio[b] = round(log((target[b] + 100 * share) / (all_target + 100) / share) * (1 << 20)) / (1 << 20)

    def spark_hash(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else pack("<q", p), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    keyed = []
    for doc_id, text in pairs:
        noise = -log(-log((((spark_hash("gumbel", spark_hash(doc_id, text or "")) & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)))
        keyed.append((sum(ratio[b] for b in plain_features(text or "")) + noise, doc_id, text))
    keyed.sort(key=lambda x: -x[0])
    return [x[1:] for x in keyed[: -(-len(keyed) * sum(q for _, q in labels) // len(labels))]]


def plain_dedup(pairs):
    from .test_operators import brute_fingerprint

    pairs = sorted(pairs)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in pairs)]
    prints, parent = [brute_fingerprint(t) for _, t in pairs], list(range(len(pairs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(pairs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [p for i, p in enumerate(pairs) if find(i) == i]


def plain_mask(text):
    from alarmloom.llm.secret_scan import BASE_RULES, MORE_RULES, plain_spans

    if text is None:
        return None
    out, reach = "", 0
    spans = [(start, end) for _, start, end in plain_spans(text, BASE_RULES + MORE_RULES)]
    for start, end in spans:
        if start >= reach:
            out += text[reach:start] + "[secret]"
        reach = max(reach, end)
    return out + text[reach:]


def plain_mix(rows):
    """How often each document is taken, of (doc_id, source, text)."""
    from .test_operators import water_filled, words_of

    sizes, order = defaultdict(int), defaultdict(list)
    for doc_id, source, text in rows:
        sizes[source] += words_of(text)
        order[source].append((hashlib.md5(f"mix:{doc_id}".encode()).hexdigest(), doc_id, words_of(text)))
    target, queue = water_filled(dict(sizes)), []
    for source, members in order.items():
        at = 0
        for epoch in range(3):
            for place, doc, size in sorted(members) if target[source] else []:
                at += size
                queue.append((at / target[source], place, doc, epoch, size))
    used, taken = 0, Counter()
    for _, _, doc, _, size in sorted(queue):
        if used + size > sum(sizes.values()):
            break
        used += size
        taken[doc] += 1
    return taken


def test_pipeline_against_plain_python(spark, tmp_path):
    import zlib
    from array import array

    import corpus_pipeline

    from .test_operators import SECRET, library

    rng = random.Random(17)
    words = ["w%d" % i for i in range(400)]
    made = [rng.choices(words, k=rng.randint(5, 150)) for _ in range(60)]
    made += [["v%d" % k if k == i else w for i, w in enumerate(made[n])] for n in range(10) for k in (3, 4)]  # near copies
    texts = [" ".join(x) for x in made] + [" ".join(x) + " " + SECRET for x in made[20:30]] + [" ".join(made[0]), SECRET, "a " + SECRET + " b", "", None, "junk junk " * 40, "line one\nline two " * 30]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i % 9 > 0)) for i in range(len(texts))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, source = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r[3] for r in rows}
    # stage by stage, each on what the plain version hands on
    expected = plain_draw([r[:2] for r in rows], labels)
    for k, step in enumerate((None, plain_dedup, lambda pairs: [(i, plain_mask(t)) for i, t in pairs])):
        expected = expected if step is None else step(expected)
        path = str(tmp_path / f"stage{k}")
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(expected), corpus_pipeline.STAGES[k][0]
    assert 0 < len(expected) < len(rows) and any("[secret]" in (t or "") for _, t in expected)
    taken = plain_mix([(i, source[i], t) for i, t in expected])
    plain = library(corpus_pipeline.VOCABULARY)
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [corpus_pipeline.END_ID] for i, t in expected}
    covered = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = array("I", ids[r.doc_id][r.start : r.start + r.length])
        assert (r.doc_tokens, len(part), r.ids_crc32) == (len(ids[r.doc_id]), r.length, zlib.crc32(part.tobytes()))
        covered.update((r.doc_id, r.start + i) for i in range(r.length))
    assert covered == Counter({(i, at): n for i, n in taken.items() for at in range(len(ids[i]))})
