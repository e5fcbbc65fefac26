import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empties, ties, repeated rows, white space, other scripts, no letters, one long text.
ODD = [
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, "  \t\n ", None, "s", 6),
    (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s", 80),
    (5, "zero one two three four five six seven eight nine ten eleven twelve thirteen", "en", "s", 80),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s", 80),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s", 80),
    (7, "12345 67890 !!! ???", None, "s", 19),
    (8, "Größe über alles ärgerlich   naïve \U0001f600 日本語 テキスト", "de", "s", 40),
    (9, "x", "en", "s", 1),
    (10, "the quick brown fox " * 4000, "en", "s", 80000),
    (11, "a\x1cb\x85c d e\r\n\x0bf", "en", "s", 12),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def write_tables(spark, sf_dir, tmp_path_factory):
    """A copy of the table folder with another documents table."""
    import os

    def make(docs, **more):
        folder = tmp_path_factory.mktemp("tables")
        for name in os.listdir(sf_dir):
            if name.removesuffix(".parquet") not in {"documents", *more}:
                os.symlink(f"{sf_dir}/{name}", folder / name)
        for name, df in {"documents": docs, **more}.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
