import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import SMALL, assert_same  # noqa: E402

from paralens.llm.oracles import ORACLES  # noqa: E402
from paralens.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_every_document(spark, name):
    assert QUERIES[name](spark, SMALL).select("doc_id").distinct().count() == 200


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


@pytest.fixture(scope="module")
def table(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())


def digests(spark, name, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in QUERIES[name](spark, SMALL).collect()}


def test_op3_equals_the_library(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in table], add_special_tokens=False)]
    assert digests(spark, "op3_token_counts", "n_bytes", "n_tokens", "over_limit") == {i: (len((t or "").encode()), k, k > 512) for (i, t), k in zip(table, n, strict=True)}


def test_op5_equals_brute_force(spark, table):
    from test_near_dedup import components, fingerprint

    fps = [fingerprint(t, 4) for _, t in table]
    expected = components(fps, [i for i, _ in table])
    assert digests(spark, "op5_simhash_near_dedup", "fingerprint", "component_id") == {i: (f"{f:016x}", c) for (i, _), f, c in zip(table, fps, expected, strict=True)}


def test_op6_equals_brute_force(spark, table):
    from test_line_dedup import brute

    assert digests(spark, "op6_line_dedup", "n_lines", "n_removed_lines", "kept_sha256") == brute([(i, t or "") for i, t in table])


def test_op9_equals_brute_force(spark, table):
    import zlib

    from test_sharding import brute

    placed = brute(table)
    expected = {i: (*placed[k], zlib.crc32((t or "").encode()), "bytes", None) for k, (i, t) in enumerate(table)}
    assert digests(spark, "op9_sharding", "size", "shard", "slot", "text_crc32", "law", "grown_shard") == expected
