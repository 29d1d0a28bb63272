"""Documents with every awkward shape, and plain re-statements of the contracts."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest long, words string, rid string, t string, h string, copies int, shard string, won string, lines int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick onea thander of reting and stould by the onting of thea was in an erther with ousing. "


def words(text):
    return WORD.findall(text or "")


def texts():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    passage = " ".join(f"passage{i}" for i in range(60))
    return [
        None,
        "",
        " \t\n",
        "one",
        "ÀÉÎ ñandú straße 中文 words",
        "!!! ### 123",
        PROSE * 4,
        PROSE * 4,
        f"start {passage} middle one two three",
        f"other words {passage}",
        long,
        "a b c a b c a b c " * 8,
        "nbsp inside word em and\x0bvertical\x0cfeed",
        'mail joe@example.org or x@y and 10.0.0.1 or 300.1.1.1 card 4111 1111 1111 1111 tel +49 (30) 123-45 token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"',
        "<|endoftext|> special   runs of  space \n and 'll contractions's",
    ]


def documents(spark):
    """The texts once, the fourth row twice more, and rows of nulls; extra columns have clashing names."""
    ts = texts()
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), *_extra()) for i, t in enumerate(ts)]
    rows += [rows[3], rows[3], (None, "null id text", None, None, None, *_extra()), (None, None, None, None, None, *_extra())]
    return spark.createDataFrame(rows, SCHEMA)


def _extra():
    return ("x", 1, "y", "z", "t", "h", 2, "s", "w", 3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
