import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from callweave.llm import manifest, oracles, queries
from tests.compare import SF, difference, duck


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout=3):
    """rows: (doc_id, source, lang, n_chars, text). Trees built whole, proofs read off, roots folded anew."""

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def sides(tree, i):
        for level in tree[:-1]:
            run = i // fanout * fanout
            yield level[run:i], level[i + 1 : run + fanout]
            i //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: levels([leaf(r) for r in ordered[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(ordered[s]):
            path = [*sides(trees[s], i), *sides(top, k)]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in (*a, *b))), now, now == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def fields(text):
    return [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]


def made(df, **more):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even & F.contains("text", F.lit("\n")), manifest.leaf_digest(fields(F.replace("text", F.lit("\n")))))
    out = manifest.manifest(df, "doc_id", "source", manifest.leaf_digest(fields(F.col("text"))), altered, **more)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_whole_table_equals_sql_and_plain_trees(spark):
    got = queries.op13_merkle_manifest(spark, SF).cache()
    assert difference(got, oracles.MANIFEST, duck()) == ""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == plain_manifest(docs)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_ranks_at_every_depth_of_digits(spark, monkeypatch, bucket):
    """A hot group, ids far apart and negative, equal ids, equal rows, null ids and groups, names that are prefixes of others."""
    monkeypatch.setattr(manifest, "BUCKET_ROWS", bucket)
    rows = [(i * 7 - 40, "hot", "en", 1, f"text {i}\nend") for i in range(40)]
    rows += [(2**62 + i, "hot", None, None, None) for i in range(3)] + [(-(2**63), "hot", "x", 2, "")]
    rows += [(5, "a", "en", 3, f"t{i % 4}\n") for i in range(12)] + [(None, "a", "en", 1, "x\n")] * 5
    rows += [(9, None, None, 1, "n"), (9, "", "en", 1, "é\n漢"), (1, "ab", "en", 1, "q"), (1, "aé", "en", 1, "q"), (2, "a\x00", "en", 1, "q"), (3, "ab c", "en", 1, "q")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(df, levels=2) == plain_manifest(rows)


def test_edge_tables(spark, empty, odd):
    assert made(empty) == []
    one = [(7, None, None, None, None)]
    assert made(spark.createDataFrame(one, SCHEMA)) == plain_manifest(one)
    df = odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("tree", F.lit(1)).withColumn("rank", F.lit("r")).withColumn("n", F.lit(2))
    plain = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert made(df) == plain_manifest(plain)
