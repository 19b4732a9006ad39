"""SimHash, mixing, sharding, URL filters and components against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")
from cases import FOLDER, awkward, documents, empty  # noqa: E402
from test_similar import brute_kept, shingles  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from xxhash import xxh64_intdigest  # noqa: E402

from lodestone.llm import mixing, sharding, simhash, urls  # noqa: E402
from lodestone.session import cut  # noqa: E402


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """doc_id -> least doc_id, of (doc_id, fingerprint)."""
    ids = sorted({i for i, _ in pairs})
    fps = collections.defaultdict(set)
    for i, f in pairs:
        fps[f].add(i)
    parent = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(parent, a)] = find(parent, b)
    least = collections.defaultdict(lambda: None)
    for f, members in fps.items():
        root = find(parent, f)
        least[root] = min(members | ({least[root]} if least[root] is not None else set()))
    assert ids is not None
    return collections.Counter((i, f"{f:016x}", least[find(parent, f)]) for i, f in pairs)


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_simhash(spark, make):
    docs = make(spark).filter("doc_id IS NOT NULL")
    rows = cut(simhash.fingerprints(docs))
    got = simhash.near_groups(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert collections.Counter(tuple(r) for r in got) == want


def test_simhash_stage(spark):
    for make in (awkward, documents, empty):
        docs = make(spark)
        rows = docs.collect()
        left = simhash.keep(spark, docs, "")
        assert left.columns == docs.columns
        left = left.collect()
        classes = brute_kept([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
        assert sorted(r.doc_id for r in left if r.doc_id is not None) == classes
        # rows without an id stay where no row with an id has their words, one of each text
        known = {shingles(r.text) for r in rows if r.doc_id is not None}
        assert len([r for r in left if r.doc_id is None]) == len({shingles(r.text) for r in rows if r.doc_id is None} - known)


@pytest.mark.parametrize("n,spread", [(3000, 12), (3000, 64), (400, 4)])
def test_vantage_trees_find_every_pair(n, spread):
    rng = np.random.default_rng(n + spread)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([rng.choice(centres, n) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, spread, (5, n), dtype=np.uint64), axis=0), rng.integers(0, 1 << 63, n, dtype=np.uint64)]))
    rng.shuffle(points)
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    parent = list(range(len(points)))
    for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        parent[find(parent, int(a))] = find(parent, int(b))
    tree = simhash.upper_tree(points[: len(points) // 3], 5)
    leaf, at, own = simhash.place(tree, points, 3)
    assert sorted(at[own]) == list(range(len(points)))
    mine = list(range(len(points)))
    for k in np.unique(leaf):
        h, v = at[(leaf == k) & own], at[(leaf == k) & ~own]
        both = np.concatenate([h, v])
        label = simhash.link(points[both], len(h), 3)
        for i, j in enumerate(label):
            mine[find(mine, int(both[i]))] = find(mine, int(both[j]))
    classes = lambda p: collections.Counter(frozenset(g) for g in _groups(p))
    assert classes(parent) == classes(mine)


def _groups(parent):
    out = collections.defaultdict(set)
    for x in range(len(parent)):
        out[find(parent, x)].add(x)
    return out.values()


def water_fill(sizes):
    """Targets by resharing the excess again and again, as it is defined."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        got = {s: left * w[s] / weight for s in free}
        over = [s for s in free if got[s] > 3 * sizes[s]]
        if not over:
            return got | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_mix(spark, make):
    docs = make(spark)
    out, _ = mixing.mix(docs)
    got = out.select("doc_id", F.when(~F.col("__none"), F.col("__source")).alias("source"), "size", "source_size", "target", "taken").collect()
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    want = water_fill(dict(sizes)) if sizes else {}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2
    again, _ = mixing.mix(docs.repartition(3))
    assert sorted(map(str, again.select("doc_id", "size", "target", "taken").collect())) == sorted(map(str, out.select("doc_id", "size", "target", "taken").collect()))


def test_mix_draws_by_key(spark):
    """The fractional epoch is the prefix of least keys of each source, and every document gets the complete epochs first."""
    out, _ = mixing.mix(documents(spark))
    by = collections.defaultdict(list)
    for r in out.select("__source", "__key", "doc_id", "size", "epochs", "taken", "target").collect():
        by[r["__source"]].append(r)
        digits = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16)
        assert r["__key"] >= -math.log((digits + 0.5) / 2**52) * 0.999999
    for rows in by.values():
        rows.sort(key=lambda r: (r["__key"], r.doc_id))
        extra = [r.taken - r.epochs * r.size for r in rows]
        full = [e == r.size for e, r in zip(extra, rows, strict=True)]
        first = full.index(False) if False in full else len(full)
        assert not any(extra[first + 1 :]) and all(e >= 0 for e in extra)


def test_mix_stage(spark):
    for make in (awkward, documents, empty):
        docs = make(spark)
        made = mixing.mix_documents(spark, docs, "")
        assert made.columns == docs.columns
        out, _ = mixing.mix(docs)
        want, got = collections.Counter(), collections.Counter()
        for r in out.select("doc_id", "taken").collect():
            want[r.doc_id] += r.taken
        for r in made.collect():
            got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert +got == +want


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_shards(spark, make):
    docs = make(spark)
    got = sharding.shard(docs).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    total, most = sum(r.size for r in got), max((r.size for r in got), default=0)
    for k in range(8):
        mine = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= most + 0.02 * total / 8


def test_shards_of_one_hot_text(spark, monkeypatch):
    """A third of all rows are one text: its range is subdivided, and sizes stay near equal."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("cold " * 15), F.col("id").cast("string"))).alias("text"))
    base = cut(sharding.keyed(docs))
    total = base.agg(F.sum("size")).first()[0]
    cuts = sharding.splitters(base, 3000, total)
    most = base.withColumn("r", sharding._range_of(F.col("key"), cuts)).groupBy("r").count().agg(F.max("count")).first()[0]
    assert most <= 150
    got = sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and all(abs(r.s - total / 8) < 0.03 * total / 8 and r.m == r.n - 1 for r in got)


def test_small_groups_stay_in_one_shard(spark, monkeypatch):
    """Groups of equal texts within the tolerance are in one shard, though ranges are smaller than they are; rows without id and with equal ones too."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = spark.range(60_000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 100).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 600).cast("string")).alias("text"))
    got = sharding.shard(rows.withColumn("key", F.lit("clash"))).collect()
    total = sum(r.size for r in got)
    shards, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[r.text_crc32].add(r.shard)
        sizes[r.text_crc32] += r.size
    assert max(sizes.values()) <= sharding.TOLERANCE * total / 4
    got = sharding.shard(rows, 4).collect()
    shards = collections.defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert {len(s) for s in shards.values()} == {1}
    for k in range(4):
        mine = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and abs(sum(r.size for r in mine) - total / 4) <= sharding.TOLERANCE * total / 4


def test_url_targets(spark):
    """Relative targets name pages of the same host; what is commented out or within a script names none."""
    link = lambda t: f'<link rel="canonical" href="{t}">'
    rows = [
        (1, "http://a.org/x/p.html", link("y.html")), (2, "http://a.org/x/y.html", link("../z")), (3, "http://a.org/z", link("http://bad.net/")), (4, "http://c.com/k", f"<!-- {link('http://bad.net/')} -->"),
        (5, "http://d.com/k", f"<script>var s = '{link('http://bad.net/')}'</script>"), (6, "http://e.org", link("b")), (7, "http://e.org/b", link("//Bad.NET/q?x#y")), (8, "http://f.org/a", link("mailto:x@bad.net")),
        (9, "http://g.org/a/b/", link("./../../../c?d=://bad.net/")), (10, "http://g.org/c", link("#top")), (11, "http://h.org/a", link("?q=http://bad.net/")), (12, "http://i.org/a", link("/u/./v/../w")), (13, "http://i.org/u/w", link("http://x.net/")),
        (14, "http://j.org/a", f"<!-- never closed {link('http://bad.net/')}"), (15, "http://k.org/a", "<!-- x --> " + link("http://x.net/")),
    ]
    rows += [(100 + i, "http://a.org/x/p.html", None) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 6, 7, 12, 13, 15, *range(100, 150)} and len(got) == len(rows)
    edges = {(r.src, r.dst) for r in urls.links(pages).collect()}
    assert {("g.org/a/b/", "g.org/c"), ("g.org/c", "g.org/c"), ("h.org/a", "h.org/a"), ("i.org/a", "i.org/u/w"), ("e.org", "e.org/b")} <= edges and not any(s.startswith(("c.com", "d.com", "f.org", "j.org")) for s, _ in edges)

    import duckdb

    db = duckdb.connect()
    frame = pages.toPandas()
    db.register("pages", frame)
    assert sorted(str(tuple(r)) for r in urls.judge(pages).collect()) == sorted(map(str, db.sql(urls.OP10_SQL).fetchall()))


def test_url_rules(spark):
    page = lambda i, url, html="": (i, url, html)
    rows = [
        page(1, "http://x.NET/a"), page(2, "http://net/"), page(3, "http://net"), page(4, "https://m.example.net/en/1?q=/de/"), page(5, "https://example.net/en"), page(6, "http://a.example.com/de/1#x"),
        page(7, "http://aexample.com/de/1"), page(8, None), page(9, "no scheme"), page(10, ""), page(11, "http://b.org/fr/x"), page(12, "http://?a"), page(13, "a://b://c.net/x"), page(14, "http://x.org/de/://net/"),
        page(20, "http://good.org/a", "<head><LINK href='http://bad.net/b' rel=\"canonical\"></head>"), page(21, "http://bad.net/b"), page(22, "http://good.org/c", '<meta http-equiv="refresh" content="0; url=/a">'),
        page(23, "http://z.org/fr/1", '<link rel="canonical" href="http://good.org/c?x=1">'), page(24, "http://lone.org/", '<link rel="canonical" href="https://lone.org/b">'), page(25, "http://s.org/", '<link rel=stylesheet href="http://q.net/">'), page(26, "http://n.org/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {
        1: ("x.net", "/a", "net/", "block"), 2: ("net", "/", "net/", "block"), 3: ("net", "", None, "allow"), 4: ("m.example.net", "/en/1", "example.net/en/", "allow"), 5: ("example.net", "/en", "net/", "block"),
        6: ("a.example.com", "/de/1", "example.com/de/", "block"), 7: ("aexample.com", "/de/1", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("b.org", "/fr/x", "org/fr/", "allow"),
        12: ("", "", None, "allow"), 13: ("b:", "//c.net/x", None, "allow"), 14: ("x.org", "/de/://net/", None, "allow"),
        20: ("good.org", "/a", None, "block"), 21: ("bad.net", "/b", "net/", "block"), 22: ("good.org", "/c", None, "block"), 23: ("z.org", "/fr/1", "org/fr/", "allow"), 24: ("lone.org", "/", None, "allow"), 25: ("s.org", "/", None, "allow"), 26: ("n.org", "/", None, "allow"),
    }
    more = spark.createDataFrame([("http://n.org/", "http://lone.org/b"), ("http://lone.org/", "http://www.net/x"), (None, "http://a.net/")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, redirects=more).collect()}
    assert got[24] == got[26] == "block" and got[23] == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_match_sql(spark, tmp_path):
    import duckdb

    rows = [(i, f"http://h{i % 7}.{'net' if i % 5 == 0 else 'org'}/{'fr' if i % 11 == 0 else 'p'}/{i}", f'<link rel="canonical" href="http://h{i % 3}.org/p/{i // 2}">' if i % 2 else None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    db = duckdb.connect()
    frame = pages.toPandas()
    db.register("pages", frame)
    want = sorted(map(str, db.sql(urls.OP10_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in urls.judge(pages).collect()) == want
    db.sql(f"create view p2 as select * from '{FOLDER}/pages.parquet'")
