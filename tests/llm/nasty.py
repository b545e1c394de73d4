"""A small table with everything that operators must stand."""

import random

from pyspark.sql import types as T

CLASH = ("n_words", "copy", "position", "fingerprint", "kept", "removed", "items", "spans", "blob", "found", "labels",
         "slot", "shard", "a.b", "_slots", "_blobfound", "_xstatus", "we`ird", "with space", "quality", "x", "y", "_x", "text_", "n_chars", "score", "outcome", "refers_to")


def texts(seed=7):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dëlta", "eps1lon", "zêta", "ETA", "theta", "iota's", "kappa", "license", "token"]

    def prose(n):
        return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".\n", " \t"]) for _ in range(n))

    shared = " ".join(f"shared{i}" for i in range(60))
    base = prose(80)
    item = "one two three four five six seven eight nine ten eleven twelve"
    key = "A1b2" * 6
    out = [None, "", "   \n\t ", "one", "two words", "tie tie tie", "!!! ??? ###", "日本語 のテキスト です", base, base,
           base + " more", base.replace("alpha", "ALPHA"), prose(5000), shared, "head line\n" + shared + "\ntail line here", "x" * 200_000,
           "lead in " + item + " lead out", item.upper().replace(" ", ", "), "short item", "a short item here", " ".join(["same"] * 400),
           f'password = "{key}" and AKIA{"Q" * 20} then {"0af" * 8} token: short secret={"z" * 11}', "token=secret=abcdefghijkl1 tokenToken",
           "Licensed under the Apache License, Version 2.0. CC-BY cc by; MIT  License\nGNU General Public License", "cc by cc by cc bye mit licenses"]
    return out + [prose(r.randrange(1, 60)) for _ in range(25)]


def documents(spark, clash=True):
    """doc_id, text, lang, source, n_chars and columns named like what operators add; with null ids and repeated rows."""
    t = texts()
    rows = [(i, x, "en", ["src0", None, "s2"][i % 3]) for i, x in enumerate(t)]
    rows += [(None, "row without an id", "en", "src0"), (None, t[8], None, None), rows[8], rows[13], (3, "another text of id three", "en", "s2")]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    names = [c for c in CLASH] if clash else ["n_chars"]
    rows = [(*r, *[f"{c}-{i}" for c in names]) for i, r in enumerate(rows)]
    # repeated rows are equal in every column
    rows += [rows[-1], rows[9]]
    return spark.createDataFrame(rows, T.StructType(fields + [T.StructField(c, T.StringType()) for c in names]))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)
