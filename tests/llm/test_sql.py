"""The operators' SQL against their queries, on the given tables and on odd rows."""

import random

import duckdb
import pytest

from spindle.llm import queries, secrets

from .conftest import DOCS

TABLES = {name: "embeddings" if "top_k" in name else "documents" for name in queries.ORACLE_SQL}


def rounded(rows, names):
    return sorted((tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names) for r in rows), key=str)


def same(name, spark, folder):
    con = duckdb.connect()
    con.sql(f"create view {TABLES[name]} as select * from '{folder}/{TABLES[name]}.parquet{'/*.parquet' if 'odd' in folder else ''}'")
    found = con.sql(queries.ORACLE_SQL[name])
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    return rounded(got, sorted(found.columns)) == rounded(want, sorted(found.columns)) and (not got or sorted(got[0]) == sorted(found.columns))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_given_tables(name, spark, sf):
    assert same(name, spark, sf)


@pytest.mark.parametrize("name", sorted(n for n, t in TABLES.items() if t == "documents"))
def test_odd_rows(name, spark, corpus, tmp_path_factory):
    """Nulls, empty texts, repeated rows, one doc_id with two texts (a copy of another, and nearly a third) and none at all."""
    folder = str(tmp_path_factory.mktemp("odd"))
    extra = [] if "mixing" in name else [(2001, corpus[7][1], "en", "a", 1), (2001, corpus[9][1] + " more", "en", "a", 1), (2001, "", "en", "a", 1)]
    spark.createDataFrame(corpus + extra, DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    assert same(name, spark, folder)
    nothing = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(f"{nothing}/documents.parquet")
    assert same(name, spark, nothing)


def test_tokens_of_every_encoding(spark, tmp_path_factory):
    """The randomness battery against its SQL: tokens of all alphabets and lengths, names, ordered ones, many or none in a document."""
    rng = random.Random(11)
    some = lambda of, *n: "".join(rng.choice(of) for _ in range(rng.randint(*n)))
    alphabets = [secrets.HEX_ALPHABET, secrets.HEX_ALPHABET.upper(), secrets.BASE32_ALPHABET, secrets.BASE36_ALPHABET, secrets.BASE36_ALPHABET.upper(), secrets.BASE64_ALPHABET, "abcdefgh"]
    words = "the of and report window market number table station river".split()

    def token():
        kind = rng.randrange(6)
        random_ = some(rng.choice(alphabets), 20, 90)
        return [random_, "-".join(random_[i : i + 8] for i in range(0, len(random_), 8)), rng.choice(["Api_Key='", "TOKEN = \"", "secret:"]) + some("aZ0_.", 5, 12), "AKIA" + some("AB01", 10, 18), (secrets.HEX_ALPHABET * 4)[: rng.randint(24, 60)], "_".join(rng.choice(words) + rng.choice(["", "1", "22"]) for _ in range(6))][kind]

    docs = [(i, rng.choice([" ", "\n", " é日 "]).join(token() if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 50)))) for i in range(500)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert same("op3_secret_scan", spark, folder)
    assert secrets.scan(spark.read.parquet(f"{folder}/documents.parquet")).agg({"n_random": "sum"}).first()[0] > 500
