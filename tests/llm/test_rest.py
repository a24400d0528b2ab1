"""Near duplicates, vectors, archives, urls and the pipeline on small tables."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftglass.llm import common, forest, minhash, topk, urls, warc

from .helpers import AWKWARD, DOCUMENTS, LABELS, PAGES, VECTORS, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def smallest_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- near-duplicate documents --------------------------------------------------------------


@pytest.mark.parametrize("words, percent, block", [(3, 85, 1024), (5, 80, 1024), (3, 85, 7)])
def test_near_documents_equal_brute_force(spark, words, percent, block):
    draw = random.Random(words)
    docs, base = {}, [[f"W{draw.randint(0, 300)}" for _ in range(draw.randint(1, 60))] for _ in range(12)]
    for d in range(260):
        text = list(base[0] if d % 2 else draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = f"n{draw.randint(0, 9)}"
        docs[d] = " ".join(text)
    docs |= {300: "", 301: None, 302: "One\tTWO", 303: "one two", 304: "É b c", 305: "é b c", 306: "w " * 30_000, 307: "w w w " * 10}
    sets = {d: shingles(t, words) for d, t in docs.items()}
    linked = [(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    table = spark.createDataFrame([(d, t, "en", "x", 0) for d, t in docs.items()], DOCUMENTS).withColumn("component", F.lit(0))
    got = {r.doc_id: r for r in minhash.near_documents(table, words, percent, block).collect()}
    expected = smallest_reachable(docs, linked)
    assert {d: r.component_id for d, r in got.items()} == expected
    assert all(r.n_shingles == len(sets[d]) and r.kept == (r.component_id == d) for d, r in got.items())
    left = minhash.deduplicate(table, words, percent)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d in docs if expected[d] == d}


def test_near_documents_awkward_rows(spark):
    table = spark.createDataFrame(AWKWARD, DOCUMENTS)
    got = minhash.near_documents(table, 3, 85).collect()
    assert len(got) == len(AWKWARD)
    nulls = {r.n_shingles: r for r in got if r.doc_id is None}
    assert nulls[4].component_id == 1 and not nulls[4].kept and nulls[0].component_id is None and nulls[0].kept
    assert minhash.near_documents(table.limit(0)).count() == 0


def test_deduplicate_follows_the_marks(spark):
    draw = random.Random(3)
    say = lambda: [f"w{draw.randint(0, 5000)}" for _ in range(60)]
    three, own, lone, twice, other = (" ".join(say()) for _ in range(5))
    near = " ".join([*own.split(" ")[:-1], "changed"])
    docs = [(3, three), *[(None, three)] * 3, (None, lone), *[(None, twice)] * 2, (7, three), (7, own), (8, near), (9, ""), (9, near), (10, ""), (10, None),
            (11, other), (11, other), (12, three.upper()), (None, three.upper()), (None, None)]
    table = spark.createDataFrame([(d, t, "en", "x", 0) for d, t in docs], DOCUMENTS).repartition(3)
    marks = sorted(((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash.near_documents(table, 5, 80).collect()), key=repr)
    of = {3: 3, 7: 3, 8: 3, 9: 3, 12: 3, 10: 10, 11: 11}
    component = lambda d, t: of[d] if d else 3 if t and t.lower() == three else None
    assert marks == sorted(((d, bool(t), component(d, t), component(d, t) == d) for d, t in docs), key=repr)
    left = rows(minhash.deduplicate(table, 5, 80), "doc_id", "text")
    assert left == sorted([(d, t) for d, t in docs if component(d, t) == d], key=repr)


def test_sketch_agreement_follows_similarity():
    random_ = np.random.default_rng(4)
    pool = random_.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    for shared in (300, 900):
        a, b = pool[:1000], np.r_[pool[1000 - shared:1000], pool[1000:1000 + 1000 - shared]] if shared < 1000 else pool
        b = np.r_[pool[:shared], pool[1000:1000 + min(500, 1000 - shared)]]
        true = shared / len(set(a.tolist()) | set(b.tolist()))
        hashes, owners = np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        s = minhash.sketches(hashes, owners, 2, 2000)
        assert abs((s[0] == s[1]).mean() - true) < 0.05
    tiny = minhash.sketches(np.array([7], np.uint64), np.array([0]), 2, 50)
    assert (tiny[0] != np.iinfo(np.uint64).max).all() and (tiny[1] == np.iinfo(np.uint64).max).all()


def test_long_text_hashes_like_its_parts():
    raw = b" ".join(b"w%d" % (k % 977) for k in range(40_000))
    was = common._PIECE
    whole = common._hash_words([raw])[0]
    try:
        common._PIECE = 1000
        assert (common.hash_words([raw])[0] == whole).all()
    finally:
        common._PIECE = was


def test_components(spark):
    draw = random.Random(8)
    linked = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    got = dict(map(tuple, common.components(spark.createDataFrame(linked, "a long, b long"), "a", "b").collect()))
    ids = {i for pair in linked for i in pair}
    expected = smallest_reachable(ids, linked)
    assert got == {i: c for i, c in expected.items() if any(i in p and p[0] != p[1] for p in linked)}


def test_components_of_few_links_are_few_files(spark):
    """Whatever the number of shuffle partitions, also where adaptive execution may not join them."""
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        found = common.components(spark.range(3000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b")), "a", "b")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert found.count() == 6000 and found.filter("component <> id - id % 2").count() == 0


def test_small_staged_tables_are_few_files(spark, monkeypatch):
    """No step of near-duplicate removal writes a file for each shuffle partition of a small table, and the result is the same."""
    texts = [" ".join(f"w{(k // 3 * 97 + j) % 1009}" for j in range(40 + k % 3)) for k in range(1500)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    expected = rows(minhash.near_documents(documents))
    names = {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {name: spark.conf.get(name) for name in names}, {}

    def counted(df, name):
        out = common.stage(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        got = rows(minhash.near_documents(documents))
        ranked = common.gathered(spark.range(500).repartition(80, "id"), 500)
        large = common.gathered(spark.range(500).repartition(80, "id"), 10**9)
        assert ranked.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and large.rdd.getNumPartitions() == 80
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == expected and sum(not r[3] for r in got) > 500
    few = {name: n for name, n in files.items() if name not in ("sketches", "sides", "joins")}
    assert set(few) == {"classes", "several", "members", "buckets", "sets", "leaders", "pairs", "placed"} and max(few.values()) <= spark.sparkContext.defaultParallelism


# --- vectors -------------------------------------------------------------------------------


def vectors(seed, n, width=16):
    random_ = np.random.default_rng(seed)
    centres = random_.standard_normal((6, width))
    out = []
    for k in range(n):
        v = centres[k % 6] + random_.standard_normal(width) * random_.choice([0.05, 0.25, 0.5])
        out.append((k, [float(np.float32(x)) for x in v], int(k % 3)))
    out += [(n + k, *out[5][1:]) for k in range(20)]
    out += [(n + 30, None, 1), (n + 31, [0.0] * width, 1), (n + 32, [float("nan")] + [1.0] * (width - 1), 1), (n + 33, [None] + [1.0] * (width - 1), 1),
            (n + 34, [float("inf")] * width, 1), (n + 35, out[5][1], None), (n + 36, [], 1), (n + 37, [1.0, 2.0], 1), (n + 38, [2.0, 4.0], 1)]
    return out


def fine(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("leaf_rows", [2048, 24])
def test_near_vectors_equal_brute_force(spark, leaf_rows):
    data = vectors(1, 500)
    linked = []
    for i, (a, v, l) in enumerate(data):
        for b, w, m in data[:i]:
            if l == m and l is not None and fine(v) and fine(w) and len(v) == len(w) and any(v) and any(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    linked.append((a, b))
    table = spark.createDataFrame(data, VECTORS).withColumn("n", F.lit("x"))
    got = {r.vec_id: r for r in forest.near_vectors(table, leaf_rows=leaf_rows).collect()}
    expected = smallest_reachable([d[0] for d in data], linked)
    assert {k: r.component_id for k, r in got.items()} == expected
    count = dict.fromkeys(got, 0)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    assert {k: r.n_links for k, r in got.items()} == count
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert forest.near_vectors(table.limit(0)).count() == 0


def exact_links(x, ids, least=0.93):
    """(links of each vector, component of each) by all pairs of unit vectors."""
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    linked = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close)) if i < j]
    return dict(zip(ids, close.sum(axis=1).tolist())), smallest_reachable(ids, linked)


def test_forest_splits_and_loses_no_link(spark):
    """Trees that split for real: near copies of few and of many, one crowd that no split parts, sampled and unsampled forests."""
    random_ = np.random.default_rng(12)
    base = random_.standard_normal((2600, 24))
    near = base[:900] + random_.standard_normal((900, 24)) * 0.25
    crowd = base[:1] + random_.standard_normal((500, 24)) * 0.02
    x = forest.unit(np.concatenate([base, near, crowd])).astype(np.float32)
    ids = random_.permutation(len(x)).tolist()
    count, component = exact_links(forest.unit(x.astype(np.float64)), ids)
    table = spark.createDataFrame([(i, v.tolist(), 4) for i, v in zip(ids, x)], VECTORS).repartition(4)
    for options in ({"leaf_rows": 128}, {"leaf_rows": 64, "sample_rows": 400}):
        got = {r.vec_id: r for r in forest.near_vectors(table, **options).collect()}
        found = sum(r.n_links for r in got.values()) / sum(count.values())
        assert found == 1.0 and {k: r.component_id for k, r in got.items()} == component and {k: r.n_links for k, r in got.items()} == count


def test_forest_measures_its_trees():
    random_ = np.random.default_rng(2)
    x = forest.unit(random_.standard_normal((3000, 32)))
    own = forest.Forest(x, 4.0, 0.93, 256, None, None, 1e-6, 7)
    assert len(own.trees) > 1 and own.missed(x, 0.93) < 1e-3
    row, leaf = own.route(x)
    assert np.bincount(np.unique(leaf, return_inverse=True)[1]).max() * 4 <= 3 * 256 and len(np.unique(row)) == 3000
    assert len(forest.Forest(x[:100], 1.0, 0.93, 256, None, None, 1e-6, 7).trees) == 1


def test_compare_takes_little_memory_for_a_crowd():
    import tracemalloc

    random_ = np.random.default_rng(3)
    n = 1500
    x = np.ones((n, 32)) + random_.standard_normal((n, 32)) * 0.01
    table = pa.table({"h1": pa.array(np.arange(n)), "h2": pa.array(np.arange(n)), "rep": pa.array(np.arange(n)), "n": pa.array(np.ones(n, np.int64)), "v": pa.array(x.tolist()),
                      "leaf": pa.array(np.full(n, 9)), "i": pa.array(np.zeros(n, np.int32)), "j": pa.array(np.zeros(n, np.int32)), "block": pa.array(np.zeros(n, np.int32)), "leaves": pa.array([[3 + k % 2, 9] for k in range(n)])})
    tracemalloc.start()
    told = forest.compare(table, 0.93).to_pandas()
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert (told.root == 0).all() and (told.links == n // 2).all()  # half of the pairs met in an earlier leaf


def test_rows_of_one_id_share_a_component(spark):
    a, b, c = ([1.0, k, 0.0, 0.5] for k in (0.0, 4.0, -4.0))
    data = [(5, a, 1), (5, b, 1), (3, a, 1), (9, b, 1), (9, c, 1), (7, c, 1), (7, None, 1)]
    got = sorted(map(tuple, forest.near_vectors(spark.createDataFrame(data, VECTORS)).collect()))
    assert got == sorted([(5, 1, 3, False), (5, 1, 3, False), (3, 1, 3, True), (9, 1, 3, False), (9, 1, 3, False), (7, 1, 3, False), (7, 0, 7, True)])


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 7}, {"levels": (64,)}, {"levels": (3, 20, 64), "shard_rows": 16}])
def test_top_k_equals_brute_force(spark, options):
    data = vectors(2, 300) + [(1000, [1e15] * 16, 0), (1001, [-1e15] * 16, 0)]
    table = spark.createDataFrame(data, VECTORS)
    scaled = {k: [int(np.floor(1024 * float(x))) for x in v] for k, v, _ in data if fine(v)}
    expected = []
    for q in (k for k in scaled if k % 20 == 0):
        found = sorted((-min(max(sum(a * b for a, b in zip(scaled[q], v)), -2**63), 2**63 - 1), k) for k, v in scaled.items() if k != q and len(v) == len(scaled[q]))
        expected += [(q, n, k, -s) for n, (s, k) in enumerate(found[:10], 1)]
    assert rows(topk.top_k(table, every=20, **options)) == sorted(expected, key=repr)
    assert topk.top_k(table.limit(0)).count() == 0
    clashing = table.withColumns({c: F.lit("x") for c in ("query_id", "rank", "score", "v")})
    assert rows(topk.top_k(clashing, every=20, **options)) == sorted(expected, key=repr)


def test_ball_tree_leaves_nodes_out():
    random_ = np.random.default_rng(3)
    points = np.floor(random_.standard_normal((4000, 3)) * 100)
    best = topk.Best(1, 10)
    worked = topk.search(points, np.arange(4000), np.array([[90.0, 10.0, 0.0]]), np.array([-1]), best, leaf=64)
    order = np.lexsort((np.arange(4000), -(points @ [90.0, 10.0, 0.0])))[:10]
    assert best.ids[0].tolist() == order.tolist() and worked < 2000


# --- archives ------------------------------------------------------------------------------


def test_arc_versions_round_trip():
    for version in (1, 2):
        data = warc.arc_version_block("x.arc", version, "19970102030405") + warc.arc_record("http://a b/\n", b"pay\r\n\r\nload", "199701020304", version) + b"\n" + warc.arc_record(None, b"", "bad", version)
        head, one, two = warc.parse_arc(data)
        assert head["URL"] == "filedesc://x.arc" and one["URL"] == "http://a%20b/%0A" and two["URL"] == "-"
        out = b"".join(warc.convert_record(r) + b"\r\n\r\n" for r in (head, one, two))
        records = list(warc.parse_warc(io.BytesIO(out).read))
        assert [h["warc-type"] for h, _ in records] == ["warcinfo", "response", "response"]
        assert warc.split_http(records[1][1])[1] == b"pay\r\n\r\nload"
        assert records[1][0]["warc-date"] == "1997-01-02T03:04:00Z" and records[2][0]["warc-date"] == "1970-01-01T00:00:00Z"
        assert records[1][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"pay\r\n\r\nload").digest()).decode()
        assert list(warc.parse_warc(warc.inflate(gzip.compress(out[:100]) + gzip.compress(out[100:])))) == records
    dns = warc.convert_record({"URL": "dns:a.b", "IP-address": "1.2.3.4", "Archive-date": "19970102030405", "Content-type": "text/dns", "block": b"x"})
    assert b"WARC-Type: resource" in dns
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 0.0.0.0 1997 text/html 999\nshort\n"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no header\n"))


def test_revisits_name_their_record(spark, tmp_path):
    pages = [(k, f"http://a/{k}", "same " * 300) for k in range(4)]
    warc.pages_to_warc(spark.createDataFrame(pages, PAGES), f"{tmp_path}/warc")
    pick = lambda head, _: (head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), head["warc-target-uri"])
    got = warc.read_warc(spark, f"{tmp_path}/warc", pick, "kind string, id string, refers string, url string").collect()
    whole = [r for r in got if r.kind == "response"]
    assert len(whole) == 1 and whole[0].url == "http://a/3" and {r.refers for r in got if r.kind == "revisit"} == {whole[0].id}
    assert len({r.id for r in got}) == 4


def test_arc_files_convert(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    data = warc.arc_version_block("x.arc", 2) + warc.arc_record("http://a/", b"body", "19970102030405", 2)
    (tmp_path / "arc" / "x.arc.gz").write_bytes(gzip.compress(data))
    warc.convert_arc_files(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = warc.read_warc(spark, f"file://{tmp_path}/warc", lambda h, c: (h["warc-type"], len(c)), "kind string, size int").collect()
    assert sorted(r.kind for r in got) == ["response", "warcinfo"]


def test_archived_pages(spark):
    long = "ü" * 600
    pages = [(1, "http://a/", long), (2, None, long), (3, "http://b/", long), (3, "http://b/", long), (4, "x", "short"), (5, "y", "short"), (6, "z", None), (7, "z", ""),
             (None, "n", long), (8, "http://c/", "WARC/1.1\r\n\r\n" * 100), (9, "http://d/", "x" * 3_000_000), (None, "only", "q" * 2000)]
    table = spark.createDataFrame(pages, PAGES).withColumn("sha1", F.lit("clash"))
    for version in (1, 2):
        got = rows(warc.archive_pages(table, version=version))
        expected = []
        for page, _, html in pages:
            raw = (html or "").encode()
            owner = max((p for p, _, h in pages if (h or "").encode() == raw and p is not None), default=None)
            again = len(raw) >= 1000 and page != owner
            expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", owner if again else None))
        assert got == sorted(expected, key=repr)
    assert warc.archive_pages(table.limit(0)).count() == 0


def test_pages_named_like_version_blocks(spark, tmp_path):
    pages = [(1, "filedesc://pages.arc", "one"), (2, "http://a/", "two"), (3, "filedesc://", "2 0 three"), (4, "filedesc://x", "same " * 300), (5, "filedesc://y", "same " * 300)]
    table = spark.createDataFrame(pages, PAGES).coalesce(1)
    for version in (1, 2):
        got = {r.page_id: tuple(r)[2:] for r in warc.archive_pages(table, version=version).collect()}
        assert got == {p: (hashlib.sha1(h.encode()).hexdigest(), "revisit" if p == 4 else "response", 5 if p == 4 else None) for p, _, h in pages}
    warc.pages_to_warc(table, f"{tmp_path}/warc")
    shown = warc.read_warc(spark, f"{tmp_path}/warc", lambda h, _: (int(h["x-page-id"]), h["warc-target-uri"]), "page long, url string").collect()
    assert sorted(map(tuple, shown)) == [(p, u) for p, u, _ in pages]


def test_every_record_is_a_gzip_member(spark, tmp_path):
    pages = [(k, f"http://a/{k}", f"page {k} " * (k % 50)) for k in range(300)] + [(1000, "http://big/", "x" * (1 << 24))]
    table = spark.createDataFrame(pages, PAGES).repartition(2)
    warc.pages_to_warc(table, f"{tmp_path}/warc", file_bytes=4000)
    files = [f for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-")]
    assert len(files) > 4
    members = 0
    for file in files:
        data = file.read_bytes()
        assert len(data) < 70_000
        while data:
            engine = zlib.decompressobj(31)
            content = engine.decompress(data)
            assert engine.eof and (not content or content.startswith(b"WARC/1.1") and content.endswith(b"\r\n\r\n"))
            members += bool(content)
            data = engine.unused_data
    assert members == len(pages)
    shown = warc.read_warc(spark, f"{tmp_path}/warc", warc.page_row, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").collect()
    assert {r.page_id: r.payload_bytes for r in shown} == {k: len(h) for k, _, h in pages}


def test_small_partitions_share_archives(spark, tmp_path):
    pages = [(k, f"http://a/{k}", f"page {k} " * 200) for k in range(300)] + [(k, "http://b/", "same " * 300) for k in range(300, 330)] + [(330, None, None)]
    table, names = spark.createDataFrame(pages, PAGES), ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("64", "false")):
            spark.conf.set(name, value)
        warc.pages_to_warc(table, f"{tmp_path}/warc")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len([f for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-")]) <= spark.sparkContext.defaultParallelism
    shown = warc.read_warc(spark, f"{tmp_path}/warc", warc.page_row, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert rows(shown) == sorted([(p, len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if 300 <= p < 329 else "response", 329 if 300 <= p < 329 else None) for p, _, h in pages], key=repr)


# --- urls ----------------------------------------------------------------------------------


def test_urls(spark):
    pages = [(1, "http://EXAMPLE.net/en/1"), (2, "https://a.example.net/de/"), (3, "http://x.example.com/de/y?z"), (4, "http://é.org/fr/"), (5, "http://example.net"),
             (6, None), (7, "no scheme"), (8, ""), (9, "http://h?q://x/"), (10, "ftp://u@bad.host.com:80/p#f"), (11, "http://bad.host.com/1"), (12, "http://new.host.com/1"), (None, "http://bad.host.com/1"),
             (13, "http://notexample.net/en/"), (14, "http://net/"), (15, "://É.ORG/fr/#")]
    table = spark.createDataFrame([(i, u, "") for i, u in pages], PAGES).withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([("bad.host.com", 1)] * 60 + [("good.com", 0)] * 200 + [("x.org", 0)] * 50 + [(None, 1), ("y.org", None)], "host string, bad int")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(table, outcomes).collect()}
    assert got == {
        1: ("example.net", "/en/1", "example.net/en/", "allow"), 2: ("a.example.net", "/de/", "net/", "block"), 3: ("x.example.com", "/de/y", "example.com/de/", "block"),
        4: ("é.org", "/fr/", "org/fr/", "allow"), 5: ("example.net", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("h", "", None, "allow"), 10: ("u@bad.host.com:80", "/p", None, "allow"), 11: ("bad.host.com", "/1", None, "block"), 12: ("new.host.com", "/1", None, "allow"),
        None: ("bad.host.com", "/1", None, "block"), 13: ("notexample.net", "/en/", "net/", "block"), 14: ("net", "/", "net/", "block"), 15: ("É.org", "/fr/", None if False else "org/fr/", "allow")}
    assert urls.judge_urls(table, outcomes.limit(0)).filter("verdict = 'allow'").count() > 0
    assert urls.judge_urls(table.limit(0), outcomes).count() == 0
    rates = {r.host: r for r in urls.reputations(outcomes).collect()}
    assert rates["bad.host.com"].above > 0.99 and rates["good.com"].rate < 0.01
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, None, None), (80, 1, 1)], LABELS)
    shown = rows(urls.labelled_pages(spark.createDataFrame([(0, "http://a/en/1", ""), (0, "http://b/80.html", ""), (0, "http://c/x", ""), (0, None, "")], PAGES), labels))
    assert shown == [("a", 1), ("b", 1)]


def test_levels_of_hosts(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.example.co.uk": ("example.co.uk", "co.uk"), "user@h.org:80": ("h.org", "org"), "1.2.3.4": ("1.2.3.4", ""), "u@1.2.3.4:80": ("1.2.3.4", ""),
             "[2001:db8::1]:80": ("[2001:db8::1]", ""), "": ("", ""), "localhost": ("localhost", "localhost")}
    table = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *[c.alias(n) for c, n in zip(urls.levels(F.col("host")), ("domain", "suffix"))])
    assert {r.host: (r.domain, r.suffix) for r in table.collect()} == hosts
    other = spark.createDataFrame([("a.b.example.zz",)], "host string").select(*[c.alias(n) for c, n in zip(urls.levels(F.col("host"), ["example.zz"]), ("domain", "suffix"))]).head()
    assert tuple(other) == ("b.example.zz", "example.zz")


def test_beta_above_equals_a_fine_sum(spark):
    cases = [(0.3, 0.7), (1.0, 1.0), (5.0, 2.0), (40.0, 3.0), (0.01, 2.0), (2.0, 0.02), (300.0, 280.0), (0.05, 0.05), (900.0, 100.0)]
    table = spark.createDataFrame(cases, "a double, b double")
    for limit in (0.5, 0.8):
        got = {(r.a, r.b): r.share for r in table.select("a", "b", urls.beta_above(F.col("a"), F.col("b"), limit).alias("share")).collect()}
        for a, b in cases:
            t = np.linspace(-3000, 3000, 6_000_001) if min(a, b) < 0.1 else np.linspace(-60, 60, 2_000_001)
            log = -a * np.logaddexp(0, -t) - b * np.logaddexp(0, t)
            w = np.exp(log - log.max())
            assert got[a, b] == pytest.approx(w[t > np.log(limit / (1 - limit))].sum() / w.sum(), abs=2e-3)


def test_reputation_decides_like_its_sql(spark, tmp_path):
    """Hosts that are bad for sure, bad by few outcomes, and good ones of bad domains: the query against its SQL."""
    import duckdb

    from driftglass.llm import catalogue

    draw = random.Random(4)
    pages, labels = [], []
    for host, share, n in [("bad.spam.com", 0.97, 80), ("few.spam.com", 1.0, 3), ("one.fine.com", 1.0, 1), ("good.fine.com", 0.02, 90), ("half.mid.org", 0.5, 60), ("u@worse.org:81", 0.9, 70), ("10.0.0.7", 1.0, 40), ("10.0.0.8", 0.0, 40),
                           ("a.x.co.uk", 0.95, 30), ("b.x.co.uk", 0.9, 30), ("example.net", 1.0, 30)]:
        for _ in range(n):
            d = len(labels)
            labels.append((d, int(draw.random() >= share), 0))
            pages.append((d, f"http://{host}/{draw.choice(['en', 'de', 'fr'])}/{d}.html", ""))
    pages += [(9000 + k, f"https://{h}/nothing", "") for k, h in enumerate(["bad.spam.com", "few.spam.com", "new.spam.com", "10.0.0.7", "c.x.co.uk"])]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ours = rows(catalogue.queries()["op8_url_filter"](spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict")
    theirs = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({catalogue.oracle_sql()['op8_url_filter']})").fetchall(), key=repr)
    assert ours == theirs
    verdict = {p: v for p, _, _, rule, v in ours if rule is None}
    assert verdict[9000] == "block" and verdict[9002] == "allow" and verdict[9003] == "block" and len(set(verdict.values())) == 2


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(4)
    say = lambda n: " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(draw.randint(0, 99)) for _ in range(n))
    docs, labels = [], []
    for d in range(240):
        toxic = d % 6 == 0
        text = say(40) + "\n" + say(40) + (" zzvile zzvile" if toxic else "")
        docs.append((d, text, "en", f"s{d % 3}", len(text)))
        labels.append((d, 1, int(toxic)))
    passage = say(60)
    docs += [(500, passage + "\n" + say(30), "en", "s0", 1), (501, say(30) + "\n" + passage, "en", "s1", 1), (502, docs[1][1], "en", "s2", 1)]
    near = docs[2][1].split(" ")
    near[0] = "changed"
    docs.append((503, " ".join(near).replace("\n", " "), "en", "s0", 1))
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if number < 4:
            assert docs.columns == columns, name
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == {d for d in [*range(240), 500, 501, 502, 503] if d >= 240 or d % 6}
    assert set(kept[1]) == set(kept[0]) - {502} and passage in kept[1][500].text and passage not in kept[1][501].text
    assert kept[1][501].n_chars == len(kept[1][501].text)
    assert set(kept[2]) == set(kept[1]) - {503}
    assert set(kept[4]) == set(kept[3]) <= set(kept[2])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage after the classifier against a plain version of it, on what the stage before gave."""
    import collections

    import corpus_pipeline
    from driftglass.llm import mixing, packing

    from .test_texts import union_of_common_runs, water_level

    draw = random.Random(14)
    say = lambda n: " ".join(f"w{draw.randint(0, 3000)}" for _ in range(n))
    passages = [say(55) for _ in range(3)]
    docs = {d: "\n".join([say(draw.randint(5, 60)), *([passages[d % 3]] if d % 4 == 0 else []), say(draw.randint(5, 60))]) for d in range(160)}
    for k in range(30):
        near = docs[k * 5 + 1].replace("\n", " ").split(" ")
        near[draw.randrange(len(near))] = "changed"
        docs[1000 + k] = " ".join(near)
    table = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in docs.items()], DOCUMENTS)
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, table, str(tmp_path))
    assert rows(kept) == rows(table)  # nothing to learn from, nothing to reject
    removed = union_of_common_runs(docs, 25)
    left = {d: "\n".join(s for i, s in enumerate(t.split("\n")) if i not in removed[d]) for d, t in docs.items()}
    left = {d: t for d, t in left.items() if not removed[d] or len(t.split()) >= max(1, 0.2 * len(docs[d].split()))}
    kept = stages["line_dedup"](spark, kept, str(tmp_path)).cache()
    assert {r.doc_id: r.text for r in kept.collect()} == left and any(removed.values())
    sets = {d: shingles(t, 5) for d, t in left.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest_reachable(list(sets), linked)
    kept = stages["minhash_dedup"](spark, kept, str(tmp_path)).cache()
    assert {r.doc_id for r in kept.collect()} == {d for d in left if root[d] == d} and linked
    size = {r.doc_id: len(r.text.split()) for r in kept.collect()}
    of = {r.doc_id: r.source for r in kept.collect()}
    mixed = stages["mixing"](spark, kept, str(tmp_path)).cache()
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    sizes = collections.Counter()
    for d, n in size.items():
        sizes[of[d]] += n
    for source, target in water_level(sizes, mixing.WEIGHTS, 1.5, 2.0).items():
        assert abs(sum(copies[d] * size[d] for d in size if of[d] == source) - target) <= 2 * max(size.values())
    assert max(copies.values()) <= 2
    tokens = packing.Tokens(packing.tokenizer_path())
    text = {r.doc_id: r.text for r in kept.collect()}
    packed = collections.Counter()
    for p in stages["packing"](spark, mixed, str(tmp_path)).collect():
        assert p.doc_tokens == 1 + len(tokens.tokenizer.encode(text[p.doc_id], add_special_tokens=False).ids)
        packed[p.doc_id] += p.length
    assert packed == {d: n * (1 + len(tokens.tokenizer.encode(text[d], add_special_tokens=False).ids)) for d, n in copies.items()}


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    table = spark.createDataFrame(AWKWARD, DOCUMENTS)
    for k, name in enumerate(["__lines", "__gone", "row", "__row", "copies", "target", "a.b"]):
        table = table.withColumn(name, F.lit(k))
    spark.createDataFrame([(1, 1, 0), (5, None, 1), (None, 1, 1), (7, 1, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, table, str(tmp_path)), stage(spark, table.limit(0), str(tmp_path))
        assert none.count() == 0 and (number == 4 or out.columns == none.columns == table.columns), name
        assert out.select("doc_id").distinct().count() >= 1
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 0
