"""The registered queries of the subpackage: SQL where it can say them, and the pipeline stage by stage."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare
from gradeloom.llm import packing, secrets, toxicity
from gradeloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, name, FOLDER, QUERIES, SQL)
    assert line.startswith("ok"), line


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_secrets_query_has_the_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op1_secrets"](spark, FOLDER).collect():
        found = secrets.find(texts[r.doc_id])
        assert (r.spans, r.n_assign + r.n_access + r.n_hex) == (secrets.told(found.spans), len(found.base))
        assert set(found.base) <= set(found.spans)


#: The contract's base spans: matches from left to right, each placed by what stands before it; those that are too short go.
BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 'assign' AS kind, 1 AS place, regexp_extract_all(t, $assign$) AS m, string_split_regex(t, $assign$) AS s, list_transform(regexp_extract_all(t, $assign$, 2), lambda x: length(x)) AS n, 8 AS least FROM d
  UNION ALL SELECT doc_id, 'access', 2, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+'), list_transform(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x)), 16 FROM d
  UNION ALL SELECT doc_id, 'hex', 3, regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+'), list_transform(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x)), 32 FROM d),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, kind, place, length(m[i]) AS size, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM each WHERE n[i] >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place), '')) AS base_sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
""".replace("$assign$", r"""'((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)'""".replace("\\'", "''"))


def test_secrets_query_has_the_base_columns_of_its_sql(spark, tmp_path):
    rng = random.Random(11)
    value = lambda: "".join(rng.choice("aZ9+/_.=- é") for _ in range(rng.randint(4, 14)))
    parts = [
        lambda: rng.choice(["password", "PassWD", "secret", "Token", "api_key", "APIKEY"]) + rng.choice(['"', "'", ""]) + rng.choice(["=", " : ", ":  ", " "]) + rng.choice(['"', ""]) + value(),
        lambda: "AKIA" + "".join(rng.choice("AB0") for _ in range(rng.randint(9, 20))), lambda: "".join(rng.choice("0af") for _ in range(rng.randint(28, 40))),
        lambda: rng.choice([" ", "\n", "€ ", ", ", "x", "token=password=abcdefgh12 "]),
    ]
    texts = ["".join(rng.choice(parts)() for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(BASE).fetchall()}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op1_secrets"](spark, str(tmp_path)).collect()}
    assert got == want and all(sum(w[k] for w in want.values()) > 20 for k in range(3))


def test_pipeline_stages_take_effect(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "token = abcdefgh12345", "en", "s", 21)], given.schema)
    docs, columns = given.unionAll(extra), given.columns
    shots = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(path := f"{tmp_path}/{len(shots)}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        shots.append({r.doc_id: r for r in docs.collect()})
    toxic, lines, copies, masked = shots
    model_kept = {r.doc_id for r in toxicity.kept_documents(given.unionAll(extra), spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert set(toxic) == model_kept == set(lines) and {10_000, 10_001, 10_002} <= model_kept
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for r in toxic.values() for k in {key(x) for x in (r.text or "").split("\n")} if k)
    for i, r in toxic.items():
        kept = [x for x in (r.text or "").split("\n") if count[key(x)] < 10]
        assert (lines[i].text or "") == "\n".join(kept) and (lines[i].text is None) == (r.text is None)
    words = {i: tuple((r.text or "").lower().split()) for i, r in lines.items()}
    exact = {}
    for i in sorted(words):
        if words[i]:
            exact.setdefault(words[i], i)
    assert set(copies) <= {i for i in words if not words[i] or exact[words[i]] == i} and len(copies) < len(lines)
    assert {i for i, r in copies.items() if r.text != masked[i].text} == {i for i, r in copies.items() if secrets.find(r.text).spans}
    assert masked[10_002].text == "[secret]" and masked[10_002].n_chars == 8
    pieces = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    tokenizer = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    sizes = Counter()
    for r in pieces:
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in masked.items()}
    assert len({r.sequence_id for r in pieces}) <= np.ceil(sum(sizes.values()) / 4096) + 1


def test_pipeline_drops_near_copies_of_five_words_and_eight_tenths(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for scattered, passage in ((4, 0), (6, 0), (0, 17), (0, 40), (1, 0)):
        base = [word() for _ in range(200)]
        near = list(base)
        for k in range(scattered):
            near[20 + 30 * k] = word()
        near[60 : 60 + passage] = [word() for _ in range(passage)]
        texts += [" ".join(base), " ".join(near)]

    def jaccard_of(a, b, n):
        a, b = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    scores = [(jaccard_of(a, b, 3), jaccard_of(a, b, 5)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(three < 0.9 and five >= 0.8 for three, five in scores) == 2 and sum(five < 0.8 for _, five in scores) == 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, given, FOLDER).collect()}
    assert kept == {2 * k for k in range(len(scores))} | {2 * k + 1 for k, (_, five) in enumerate(scores) if five < 0.8}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.agg(F.max("length")).first()[0] <= 4096


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
