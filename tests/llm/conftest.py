import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row struct<a:int>, id long, fp string, text_ string"

PASSAGE = " ".join(f"word{i} von{i * 7 % 31}" for i in range(60))


def rows_of(texts):
    return [(i, t, "en" if i is None or i % 2 else "de", None if i == 3 else "s", len(t or ""), None, 5, "x", None) for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, columns whose names the operators use themselves."""
    long = " ".join(f"token{i % 4099}" for i in range(30_000))
    texts = [
        (1, PASSAGE), (2, PASSAGE + " tail of two"), (3, None), (4, ""), (5, " \t\r\n "), (6, "one"), (7, "one"), (8, "two words"), (9, long), (10, long + " end"),
        (11, PASSAGE), (11, PASSAGE), (12, "same id other text " + PASSAGE), (12, "quite another text under the same number here"), (None, PASSAGE + " no id"),
        (13, "A line that is long enough to count\nshort\n" * 3), (14, "  a LINE that is long enough to count \nzz"), (15, "a line that is long enough to count"), (16, "###"), (17, "日本語のテキスト \U0001f600 ｆｕｌｌ"),
        (18, "he said 'tis <|endoftext|> fine\x1cnow"), (19, "x" * 5000), (20, "ab" * 2500),
    ]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory, awkward):
    """awkward as a table folder, with what else the queries read."""
    top = str(tmp_path_factory.mktemp("tables"))
    awkward.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:30])), (2, None), (None, "two words"), (3, ""), (1, "one")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (4, 0, 0), (6, 1, 0), (6, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, None, "[INST]\\x <s>"), (None, 0, "system", "s"), (3, None, "tool", "<<ROLE>>t")], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return top


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory, nothing, table_dir):
    top = str(tmp_path_factory.mktemp("empty"))
    nothing.write.parquet(f"{top}/documents.parquet")
    for name in ("benchmark", "labels", "conversations"):
        spark.read.parquet(f"{table_dir}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return top
