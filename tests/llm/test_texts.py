"""Line dedup, toxicity, mixing, packing and sharding on small tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftglass.llm import common, lines, minhash, mixing, packing, sharding, toxicity

from .helpers import AWKWARD, DOCUMENTS, LABELS, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- line dedup ----------------------------------------------------------------------------


def union_of_common_runs(docs, least):
    """Line numbers of every document that are in a run of lines with `least` words that a smaller id holds too."""
    found, seen = {}, {}
    for doc in sorted(docs):
        x = [(i, s.strip(" \t\r\x0b\x0c"), len(words(s))) for i, s in enumerate(docs[doc].split("\n")) if words(s)]
        gone = set()
        for s in range(len(x)):
            held, total = None, 0
            for q in range(s, len(x)):
                places = seen.get(x[q][1], set())
                held = set(places) if held is None else {(o, p) for o, p in places if (o, p - 1) in held}
                if not held:
                    break
                total += x[q][2]
                if total >= least:
                    gone.update(range(x[s][0], x[q][0] + 1))
        found[doc] = sorted(gone)
        for p, (_, s, _) in enumerate(x):
            seen.setdefault(s, set()).add((doc, p))
    return found


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(3)
    pool = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(12)] + [""]
    docs = {d: "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9))) for d in range(120)}
    table = spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in docs.items()], DOCUMENTS)
    got = {r.doc_id: r for r in lines.line_report(table, min_words=8).collect()}
    expected = union_of_common_runs(docs, 8)
    assert {d: list(got[d].removed) for d in docs} == expected
    for d, text in docs.items():
        assert got[d].text == "\n".join(s for i, s in enumerate(text.split("\n")) if i not in expected[d])


def test_line_dedup_awkward_rows(spark):
    table = spark.createDataFrame(AWKWARD, DOCUMENTS).withColumn("__extra", F.lit(1)).withColumn("lines", F.lit("x"))
    out = lines.drop_repeated(table, min_words=5)
    assert out.columns == table.columns and out.count() == len(AWKWARD)
    again = table.union(table.filter("doc_id = 6").withColumn("doc_id", F.lit(60).cast("long")))
    left = lines.drop_repeated(again, min_words=5)
    assert left.filter("doc_id = 60").count() == 0 and left.filter("doc_id = 6").count() == 1
    assert lines.line_report(table.limit(0)).count() == 0


def lines_of(draw, pool):
    return list(zip(*(draw.choice(pool) for _ in range(draw.randint(1, 14)))))


def test_alignment_of_pairs_equals_brute_force():
    """Every run of enough words that both have goes, also where blocks changed places or come more than once."""
    draw = random.Random(1)
    for _ in range(1500):
        pool = [(draw.getrandbits(62), draw.randint(0, 7)) for _ in range(draw.randint(3, 12))]
        (a, wa), (b, wb) = lines_of(draw, pool), lines_of(draw, pool)
        columns = [pa.array([v], pa.list_(kind)) for v, kind in ((a, pa.int64()), (wa, pa.int32()), (b, pa.int64()), (wb, pa.int32()))]
        x, y = [i for i, w in enumerate(wa) if w], [i for i, w in enumerate(wb) if w]
        gone = set()
        for s in range(len(x)):
            for t in range(len(y)):
                k = 0
                while s + k < len(x) and t + k < len(y) and a[x[s + k]] == b[y[t + k]]:
                    k += 1
                if sum(wa[i] for i in x[s:s + k]) >= 8:
                    gone.update(range(x[s], x[s + k - 1] + 1))
        assert lines.repeated_in_pairs(*columns, 8)[0].tolist() == sorted(gone)


def test_nothing_is_deleted_without_an_alignment(monkeypatch):
    a, w = pa.array([[1, 2, 3]], pa.list_(pa.int64())), pa.array([[9, 9, 9]], pa.list_(pa.int32()))
    assert lines.repeated_in_pairs(a, w, a, w, 8)[0].tolist() == [0, 1, 2]
    monkeypatch.setattr(lines, "patience", lambda *_: [])
    assert lines.repeated_in_pairs(a, w, a, w, 8)[0].tolist() == []


@pytest.mark.parametrize("rare", [0, 1, 3, 1000])
def test_common_passages_go_whatever_counts_as_rare(spark, rare):
    draw = random.Random(6)
    say = lambda n: " ".join(f"w{draw.randint(0, 10_000)}" for _ in range(n))
    passage, other = "\n".join(say(9) for _ in range(4)), say(30)
    docs = {d: "\n".join([say(12), passage, *([other] if d % 3 == 0 else []), say(7)]) for d in range(40)}
    docs[41] = "\n".join([other, say(5), passage, say(5), passage])
    table = spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in docs.items()], DOCUMENTS).repartition(4)
    got = {r.doc_id: list(r.removed) for r in lines.line_report(table, min_words=25, rare=rare).collect()}
    assert got == union_of_common_runs(docs, 25)
    assert got[0] == [] and got[1] == [1, 2, 3, 4] and got[41] == [0, *range(2, 6), *range(7, 11)]


def test_line_dedup_long_text_and_scraps(spark):
    text = "\n".join(f"line {k} of a very long text with enough words" for k in range(30_000))
    docs = [(1, text, "en", "x", 0), (2, text + "\nand one more", "en", "x", 0), (3, "and one more", "en", "x", 0)]
    table = spark.createDataFrame(docs, DOCUMENTS)
    left = {r.doc_id: r.text for r in lines.drop_repeated(table).collect()}
    assert left == {1: text, 2: "and one more", 3: "and one more"}
    assert {r.doc_id for r in lines.drop_repeated(table, least_share=0.1).collect()} == {1, 3}


def test_clashing_columns(spark):
    names = ["__lines", "__id", "__version", "removed", "row", "version", "id", "__gone", "gone", "t1", "__best", "__new", "best", "new", "key", "a.b"]
    table = spark.createDataFrame(AWKWARD, DOCUMENTS)
    for k, name in enumerate(names):
        table = table.withColumn(name, F.lit(k))
    expected = sorted(set(map(tuple, table.drop("text", "doc_id", "lang", "source", "n_chars").collect())))
    for out in (lines.drop_repeated(table, 5), lines.dedup_lines(table, 5), minhash.deduplicate(table), sharding.assign(table, "doc_id", [1.0, 2.0], "s", "g").drop("s", "g")):
        assert out.columns == table.columns
        assert sorted(set(map(tuple, out.drop("text", "doc_id", "lang", "source", "n_chars").collect()))) == expected
    pieces = packing.pack_documents(table.withColumn("start", F.lit("x")), packing.tokenizer_path())
    assert pieces.columns == [part.split(" ")[0] for part in packing.SCHEMA.split(", ")] and {r.doc_id for r in pieces.collect()} == {r[0] for r in AWKWARD}
    assert lines.line_report(table, 5).count() == len(AWKWARD)


def test_patience_aligns_in_order():
    assert lines.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert lines.patience([5, 1, 2], [1, 2, 5]) == [(1, 0), (2, 1)]
    assert lines.patience([], [1]) == []
    assert lines.patience([7, 1, 7], [7, 2, 7, 7]) == [(0, 0)]  # nothing is there just once: the first places
    assert lines.longest_chain([(0, 2), (1, 0), (2, 1)]) == [(1, 0), (2, 1)]


# --- toxicity ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(5)
    vocabulary = {lang: ["".join(draw.choice("abcdeinorstu") for _ in range(draw.randint(2, 8))) for _ in range(300)] for lang in ("en", "de")}
    bad = {"en": ["zxvile"], "de": ["qwübel" + e for e in ("e", "er", "es", "en", "heit", "lich")]}
    docs, labels = [], []
    for d in range(700):
        lang = "en" if d % 3 else "de"
        text = [draw.choice(vocabulary[lang]) for _ in range(draw.randint(5, 80))]
        toxic = int(draw.random() < 0.25)
        for _ in range(2 * toxic):
            text.insert(draw.randint(0, len(text)), draw.choice(bad[lang]))
        docs.append((d, " ".join(text), lang, "x", 0))
        labels.append((d, 1, toxic))
    return spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(labels, LABELS), {d: t for d, _, t in labels}


def test_toxicity_held_out_accuracy(labelled):
    documents, labels, truth = labelled
    got = toxicity.judge(documents, labels).collect()
    assert len(got) == 700
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    assert np.mean([r.rejected == truth[r.doc_id] for r in unseen]) > 0.97


def test_toxicity_does_not_learn_from_held_out_labels(labelled):
    documents, labels, _ = labelled
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.judge(documents, labels), "doc_id", "score") == rows(toxicity.judge(documents, other), "doc_id", "score")


def test_toxicity_awkward_rows(spark, labelled):
    _, labels, _ = labelled
    table = spark.createDataFrame(AWKWARD, DOCUMENTS).withColumn("__score", F.lit("mine"))
    out = toxicity.drop_toxic(table, labels)
    assert out.columns == table.columns and out.count() <= len(AWKWARD)
    report = toxicity.judge(table, labels)
    assert report.count() == len(AWKWARD)
    assert len({r.score for r in report.filter("doc_id in (2, 3, 4)").collect()}) == 1
    assert toxicity.judge(table, labels.limit(0)).filter("score = 0").count() == len(AWKWARD)
    assert toxicity.judge(table.limit(0), labels).count() == 0


def by_hand(net, text):
    """The score of a text in plain Python, word by word and filter by filter."""
    word = 2**64

    def mixed(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % word
        z = (z ^ z >> 27) * 0x94D049BB133111EB % word
        return z ^ z >> 31

    def hashed(raw):
        return mixed((sum((b + 1) * pow(common._BASE, k, word) for k, b in enumerate(raw)) + len(raw) * int(common._ODD)) % word)

    words = []
    for raw in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()):
        places = [hashed(raw) % net.buckets] + [mixed(hashed(raw[:n]) ^ k) % net.buckets for k, n in enumerate(toxicity.PREFIXES, 1)]
        words.append(sum(net.embedding[p].astype(float) for p in places))
    wide, dim = max(len(w) for w in net.filters), net.embedding.shape[1]
    padded = words + [np.zeros(dim)] * (2 * wide)
    z, k = net.intercept, 0
    for w in net.filters:
        for f in range(w.shape[2]):
            best = max(sum(float(padded[i + o] @ w[o, :, f]) for o in range(len(w))) for i in range(len(words) + wide))
            z += max(best + net.bias[k], 0) * net.output[k]
            k += 1
    return 1 / (1 + np.exp(-(net.scale[0] * z + net.scale[1])))


def small_network(seed, buckets=64, dim=4, filters=3):
    random_ = np.random.default_rng(seed)
    return toxicity.Network(buckets, (random_.standard_normal((buckets, dim)) * 0.4).astype(np.float32), [random_.standard_normal((w, dim, filters)).astype(np.float32) for w in (1, 2, 3)],
                            random_.standard_normal(3 * filters).astype(np.float32) * 0.1, random_.standard_normal(3 * filters), -0.3, (0.7, 0.2))


TEXTS = ["", " ", "one", "Two Words", "ünï cödé wörds 12 here, and-there", "a longer text " * 40, "x" * 300]


def test_scores_equal_a_plain_forward_pass(spark):
    net = small_network(3)
    assert np.allclose(net.scores([t.encode() for t in TEXTS]), [by_hand(net, t) for t in TEXTS], atol=1e-6)
    table = spark.createDataFrame([(k, t, "en", "x", 0) for k, t in enumerate(TEXTS)] + [(100, None, "en", "x", 0)], DOCUMENTS)
    got = {r.doc_id: r["__score"] for r in toxicity.score(table, net).collect()}
    assert np.allclose([got[k] for k in [*range(len(TEXTS)), 100]], [by_hand(net, t) for t in [*TEXTS, ""]], atol=1e-6)


def test_gradients_equal_differences():
    net = small_network(4)
    net = toxicity.Network(net.buckets, net.embedding.astype(np.float64), [w.astype(np.float64) for w in net.filters], net.bias.astype(np.float64), net.output, net.intercept)
    ids = toxicity._split(*toxicity.features([t.encode() for t in TEXTS[2:5]], net.buckets))
    toxic, weight = np.array([1, 0, 1]), np.array([0.5, 1.5, 1.0])

    def loss():
        z = []
        for i in ids:
            x = np.concatenate([net.words(i), np.zeros((3, net.embedding.shape[1]))])
            best = np.concatenate([r.max(axis=0) for r in net.responses(x, np.arange(len(i)))])
            z.append(np.maximum(best + net.bias, 0) @ net.output + net.intercept)
        p = 1 / (1 + np.exp(-np.array(z)))
        return float((weight * -(toxic * np.log(p) + (1 - toxic) * np.log(1 - p))).mean()) + 5e-5 * (net.output**2).sum() + 5e-6 * sum((w**2).sum() for w in net.filters)

    grads, slope, touched, total = toxicity.gradients(net, ids, toxic, weight)
    for array, grad in [*zip([*net.filters, net.bias, net.output], grads), (net.embedding, None)]:
        for at in np.random.default_rng(5).permutation(array.size)[:12]:
            place = np.unravel_index(at, array.shape)
            value, step = array[place], 1e-6
            array[place] = value + step
            up = loss()
            array[place] = value - step
            down = loss()
            array[place] = value
            told = grad[place] if grad is not None else (total[list(touched).index(place[0])][place[1]] if place[0] in touched else 0.0)
            assert told == pytest.approx((up - down) / (2 * step), abs=1e-6)
    assert slope.sum() == pytest.approx(sum(weight * 0 + slope))


def test_sample_is_bounded_by_bytes(labelled):
    documents, labels, truth = labelled
    small = toxicity.judge(documents, labels, sample_bytes=20_000).collect()
    assert len(small) == 700 and all(0 <= r.score <= 1 for r in small)
    assert toxicity.judge(documents, labels, sample_bytes=0).select("score").distinct().count() == 1


def test_all_labels_are_learnt_from(spark):
    """A word that only late ids (by hash) and one that only a text of over 200,000 characters teach: more labels and a longer text than were once looked at."""
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdeinorstu") for _ in range(6)) for _ in range(200)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    ids = spark.range(8400).select("id", F.xxhash64("id").alias("h"), toxicity.held_out(F.col("id")).alias("out")).orderBy("h").collect()
    toxic_ids = [r for r in ids if r.id % 7 < 3]
    seen = [r.id for r in toxic_ids if not r.out]
    assert len(seen) > 2650
    late = {*seen[2500:], *[r.id for r in toxic_ids if r.out][:40]}
    docs = [(d, say(6) + (" qlatevile" if d in late else " zxvile" if d % 7 < 3 else ""), "en", "x", 0) for d in range(8400)]
    long = [d for d in range(9000, 9060) if zlib.crc32(str(d).encode()) % 4 != 2][:8]
    docs += [(d, say(20_000) + " zlongvile " + say(20_000), "de", "x", 0) for d in long]
    assert all(len(d[1]) > 200_000 for d in docs[-8:])
    docs.append((9999, say(6) + " zlongvile", "en", "x", 0))
    table = spark.createDataFrame(docs, DOCUMENTS)
    labels = spark.createDataFrame([(d, 1, int(d % 7 < 3)) for d in range(8400)] + [(d, 1, 1) for d in long], LABELS)
    net = toxicity.fit(table, labels, shard_bytes=250_000)
    got = {r.doc_id: r["__score"] for r in toxicity.score(table, net).collect()}
    unseen = [r.id for r in toxic_ids if r.out and r.id in late]
    assert len(unseen) == 40 and np.mean([got[d] >= 0.3 for d in unseen]) > 0.95
    assert np.mean([got[d] < 0.3 for d in range(8400) if d % 7 >= 3]) > 0.95 and got[9999] > 0.3
    assert toxicity.labelled(table, labels)[0].count() == sum(not r.out for r in ids) + len(long)


def test_long_texts_are_trained_by_the_parts_that_matter():
    net = small_network(6)
    text = b" ".join(b"w%d" % k for k in np.random.default_rng(2).integers(1000, size=9000))
    short = toxicity._excerpt(net, text)
    assert len(short) < len(text) and (net.pooled([short]) >= net.pooled([text]) - 1e-5).all()
    counts = toxicity.bucket_counts([text, b"w1"], np.array([1, 0]), 64, limit=1000)
    plain = [np.bincount(np.unique(toxicity.features([raw], 64)[0]), minlength=64) for raw in (b"w1", text)]
    assert np.array_equal(counts, plain)


def test_calibration_equals_plain_versions(spark):
    random_ = np.random.default_rng(3)
    z = np.round(random_.normal(size=600), 2)
    toxic = (random_.random(600) < 1 / (1 + np.exp(-2 * z))).astype(int)
    langs = random_.choice(["a", "b"], 600)
    table = spark.createDataFrame([(str(l), int(t), float(x)) for l, t, x in zip(langs, toxic, z)], "lang string, toxic int, logit double").repartition(5)
    for lang, (cut, below, hits) in toxicity.best_cuts(table).items():
        own, hit = z[langs == lang], toxic[langs == lang]
        f1 = {c: 2 * hit[own >= c].sum() / ((own >= c).sum() + hit.sum()) for c in own}
        assert cut == max(f1, key=lambda c: (f1[c], c)) and below == max(own[own < cut]) and hits == hit.sum()
    slope, offset = toxicity.platt(table)
    target = np.where(toxic == 1, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((toxic == 0).sum() + 2))
    p = 1 / (1 + np.exp(-(slope * z + offset)))
    assert abs(((p - target) * z).sum() + 1e-3 * (slope - 1)) < 1e-5 and abs((p - target).sum() + 1e-3 * offset) < 1e-5


def test_long_texts_are_scored_whole():
    random_ = np.random.default_rng(1)
    net = toxicity.Network(64, random_.standard_normal((64, 4)).astype(np.float32), [random_.standard_normal((w, 4, 3)).astype(np.float32) for w in (1, 2, 3)],
                           np.zeros(9, np.float32), np.ones(9), 0.0)
    text = b" ".join(b"w%d" % random_.integers(1000) for _ in range(3000))
    whole = net.pooled([text])
    parts = list(toxicity.segments(text, 2, 500))
    assert len(parts) > 10
    assert np.allclose(np.max([net.pooled([p]) for p in parts], axis=0), whole)


# --- mixing --------------------------------------------------------------------------------


def water_level(sizes, weights, share, ceiling):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    free, target, left = set(names), {}, share * sum(sizes.values())
    while free:
        each = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if each[s] > ceiling * sizes[s]}
        if not full:
            return target | each
        for s in full:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing_meets_targets(spark):
    draw = random.Random(9)
    docs = [(d, "w " * draw.randint(0, 60), "en", draw.choice(["a", "b", "B", "ü", None, "c", "c", "c", "c"]), 0) for d in range(3000)]
    docs += [(5000 + d, "", "en", "empty", 0) for d in range(3)]
    table = spark.createDataFrame(docs, DOCUMENTS)
    got = mixing.mix_documents(table).withColumnRenamed("doc_id", "d").join(table, F.col("d") == F.col("doc_id")).collect()
    sizes = {}
    for _, text, _, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = water_level(sizes, mixing.WEIGHTS, 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 120, source
    assert rows(mixing.mix_documents(table.repartition(7))) == rows(mixing.mix_documents(table))


def test_mix_itself_repeats_rows(spark):
    table = spark.createDataFrame(AWKWARD * 3, DOCUMENTS).withColumn("copies", F.lit(1)).withColumn("size", F.lit("big")).withColumn("target", F.lit(0))
    out = mixing.repeat_documents(table)
    assert out.columns == table.columns
    taken = mixing.mix_documents(table).agg(F.sum("taken")).head()[0]
    assert sum(len(words(r.text)) for r in out.collect()) == taken
    assert mixing.mix_documents(table.limit(0)).count() == 0


# --- packing -------------------------------------------------------------------------------


def least_squares(lengths, size):
    count, levels = [0] * (size + 1), []
    for n in lengths:
        best = None
        for a in range(size - n, -1, -1):
            if a and not count[a]:
                continue
            now = count[:]
            if a:
                now[a] -= 1
            if a + n < size:
                now[a + n] += 1
            squares = sum(c * c for c in now)
            if best is None or squares < best[0]:
                best = (squares, a, now)
        levels.append(best[1])
        count = best[2]
    return levels


def test_packer_follows_the_sum_of_squares():
    draw = random.Random(1)
    for _ in range(60):
        size = draw.randint(2, 40)
        lengths = [draw.randint(1, size - 1) for _ in range(60)]
        packer = packing.Packer(size)
        assert [packer.place(n)[1] for n in lengths] == least_squares(lengths, size)


def test_packing_round_trip(spark):
    draw = random.Random(2)
    docs = [(d, " ".join(draw.choice(["alpha", "beta", "gamma's", "d\n\ne", "  ", "<|endoftext|>", "ünï", "12"]) for _ in range(draw.randint(0, 900))), "en", "x", 0) for d in range(200)]
    docs += [(1000 + k, *r[1:]) for k, r in enumerate(AWKWARD) if r[0] != 5]
    table = spark.createDataFrame(docs, DOCUMENTS).repartition(3)
    tokens = packing.Tokens(packing.tokenizer_path())
    expected = {d: [*tokens.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for d, t, *_ in docs}
    pieces = packing.pack_documents(table, packing.tokenizer_path(), 256).collect()
    at, used = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.doc_tokens == len(expected[p.doc_id])
        ids = np.array(expected[p.doc_id][p.start:p.start + p.length], dtype="<u4")
        assert p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.length == len(ids) > 0
        at[p.doc_id] = p.start + p.length
    assert at == {d: len(t) for d, t in expected.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values()) <= 256 and sum(v < 256 for v in used.values()) <= 3
    assert packing.pack_documents(table.limit(0), packing.tokenizer_path()).count() == 0
    assert packing.pack_documents(spark.createDataFrame(AWKWARD, DOCUMENTS), packing.tokenizer_path()).select("doc_id").distinct().count() == 9


def test_packing_long_white_space(spark):
    tokens = packing.Tokens(packing.tokenizer_path())
    assert tokens.fast is not None
    texts = [" " * 1_200_000, "one\n" + "\n" * 1_010_000 + "two", "a \t" * 400_000 + "b"]
    for text in texts:
        assert np.array_equal(tokens.encode(text), tokens.tokenizer.encode(text, add_special_tokens=False).ids)
    docs = [(1, "before", "en", "x", 6), (2, texts[1], "en", "x", len(texts[1])), (3, "after", "en", "x", 5)]
    pieces = packing.pack_documents(spark.createDataFrame(docs, DOCUMENTS).coalesce(1), packing.tokenizer_path()).collect()
    ids = {d: np.array([*tokens.tokenizer.encode(t, add_special_tokens=False).ids, packing.END], dtype="<u4") for d, t, *_ in docs}
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == {(d, len(x)) for d, x in ids.items()}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes()) for p in pieces)


# --- sharding ------------------------------------------------------------------------------


def test_sharding(spark):
    docs = [(d, f"text {d % 40}", "en", "x", 0) for d in range(4000)] + AWKWARD
    table = spark.createDataFrame(docs, DOCUMENTS).withColumn("shard", F.lit("mine"))
    got = sharding.shard_documents(table, [1.0] * 40).collect()
    assert len(got) == len(docs)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 40 for r in got)
    assert 0.5 < moved / (len(got) / 41) < 1.6
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 5}) == 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].size == 16 and by_id[2].text_crc32 == 0
    assert by_id[8].size == 16 + len(AWKWARD[-1][1].encode()) and by_id[8].text_crc32 == zlib.crc32(AWKWARD[-1][1].encode())
    bigger = {r.doc_id: r.shard for r in sharding.shard_documents(table, [1.0] * 41).collect()}
    assert all(bigger[r.doc_id] == r.grown_shard for r in got)


def test_weighted_shards(spark):
    placed = sharding.assign(spark.range(20_000), "id", [1.0, 2.0, 5.0])
    share = {r.shard: r["count"] / 20_000 for r in placed.groupBy("shard").count().collect()}
    assert share == pytest.approx({0: 1 / 8, 1: 2 / 8, 2: 5 / 8}, abs=0.015)
    with pytest.raises(ValueError):
        sharding.assign(spark.range(1), "id", [0.0])
