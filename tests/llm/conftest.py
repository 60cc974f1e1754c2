"""Small awkward tables for all operators."""
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside, as columns of other types
CLASH = "key string, size string, id string, n string, found int, hash string, copies string, shard string, slot string, body string, h string, place string, s2 string, bits int"


def words(text):
    return WORD.findall(text or "")


def passage(start, n):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, wordless, short and very long texts, repeated rows and ids, copies, near copies, null keys and sources."""
    shared, long = passage(0, 60), passage(10_000, 6000)
    near = passage(500, 120)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b ", "en", "a", 5),
        (4, "One", "en", "b", 3),
        (5, shared, "en", "a", 1),
        (6, f"start here {shared} and on", "en", "b", 1),
        (7, long, "de", "a", 1),
        (8, long + " tail", "de", "c", 1),
        (9, near, "de", "c", 1),
        (10, near.replace("w510 ", "W510 "), "fr", None, 1),
        (11, near.replace("w600 ", "other "), "fr", "é", 1),
        (12, "été 🙂 Über straße mail a.b@c.de, 4111 1111 1111 1111, +49 (0)30 123456 at 192.168.0.1", "fr", "a", 1),
        (12, "été 🙂 Über straße mail a.b@c.de, 4111 1111 1111 1111, +49 (0)30 123456 at 192.168.0.1", "fr", "a", 1),
        (13, "<|im_end|> <|endoftext|>  two  spaces\n\n\nlines ", None, "b", 1),
        (13, "the same id, another text", None, "b", 1),
        (None, "no id here", "en", "b", 1),
        (None, "no id here", "en", "b", 1),
        (None, shared, None, None, 1),
        (20, "same " * 100, "en", "a", 1),
        (21, "a b c 12345", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def table(spark):
    """Rows as a table, read back from files, with columns whose names clash."""

    def make(rows, columns=COLUMNS, clash=CLASH):
        df = spark.createDataFrame(rows, columns)
        names = [c.split() for c in clash.split(", ") if c.split()[0] not in df.columns]
        df = df.selectExpr("*", *[f"cast('7' as {kind}) as {name}" for name, kind in names])
        from squallframe.session import settle

        return settle(df)

    return make


@pytest.fixture(scope="session")
def docs(table, awkward):
    return table(awkward)


@pytest.fixture(scope="session")
def no_docs(table):
    return table([])
