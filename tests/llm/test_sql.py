"""Queries against their SQL: on the smallest tables, and on rows with nulls, empty texts,
repeats and ties."""

import duckdb
import pytest
from pyspark.sql import Row

from tesselwork.llm import queries

COPY = "the quick brown fox jumps over the lazy dog and then it runs back home again. " * 4
HEAD = "A line that many pages of this host have in common\n"
BODY = " ".join(f"w{i}" for i in range(60))
DOCUMENTS = (
    [(1, None, None), (2, "", "b"), (3, " \n\t ", "b"), (None, "no id but SOME words; x", None), (4, COPY, "a"), (4, COPY, "a"), (5, "before " + COPY + "after", "b"), (6, COPY + COPY, "c")]
    + [(7, "é" * 300, "d"), (8, "é" * 150 + "x" + "é" * 150, "d"), (9, "One two THREE\nOne two THREE\none two three\n\n", "a"), (10, "word joined $%& <b>", None)]
    + [(20 + i, HEAD + HEAD.upper() + (BODY if i % 2 else ""), "h") for i in range(14)]
    + [(40, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"), (41, "Alpha, BETA! gamma-delta epsilon zeta eta theta. Short one", "a"), (42, "x " * 5000, "e")]
)
BENCHMARK = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (10, "short ONE"), (2, "beta gamma delta epsilon zeta eta theta iota kappa"), (2, "beta gamma delta epsilon zeta eta theta iota kappa"), (3, None), (4, ""), (5, "..."), (None, "x x"), (6, "x x x")]
CONVERSATIONS = [
    (1, 0, "user", "Who has the key?\n\nIt was on the   table."),
    (1, 1, "user", "> Who has the key?\n\nI do."),
    (1, 2, "user", "Anna wrote:\n> it was ON the table.\n> nobody said this\n\nNot any more."),
    (1, 3, "user", ">> Who has the key?\n> I do.\nGood."),
    (2, 0, "user", "> I do.\nSaid elsewhere."),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 0, "user", "> \n>\n> Who has the key?"),
    (None, None, None, "no place"),
    (3, 5, "user", "ok"),
    (3, 6, "user", "> ok\nfine"),
    (4, 0, "user", "One line here.\nA second line there.\n\nAnd a third, which is a paragraph."),
    (4, 1, "user", "> a second LINE there.\n>\n> And a third, which\n> is a paragraph.\n\nTo these two."),
    (4, 2, "user", "Bob wrote:\n> never said by anybody\nStill mine."),
    (4, 3, "user", ">> A second line there.\n> To these two.\nDeep."),
    (4, 4, "user", "> Deep.\nDeeper.\nDeeper."),
    (4, 5, "user", "> One line here.\n> One line here.\nLate reply."),
    (4, 6, "user", "> Still mine.\n> said nowhere, and much longer than the other line\nok"),
    (4, 6, "user", "> Deeper.\nok"),
    (4, 7, "user", "> ok\nTwice said before."),
    (5, 0, "user", "> Late reply.\n> Twice said before.\nfrom two, in another conversation"),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([Row(*r) for r in DOCUMENTS], "doc_id long, text string, source string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "conversations"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def rows(columns, found):
    return sorted([repr(x) for x in r] for r in found), columns


@pytest.mark.parametrize("where", ("sf_dir", "odd_dir", "empty_dir"))
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, request, name, where):
    root = request.getfixturevalue(where)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        path = f"{root}/{t}.parquet" + ("" if where == "sf_dir" else "/*.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    got = queries.queries()[name](spark, root)
    columns = sorted(got.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(columns, ([r[c] for c in columns] for r in got.collect())) == rows(columns, ([r[i] for i in at] for r in found.fetchall()))
