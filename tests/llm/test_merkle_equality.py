"""Roots of the Merkle tree tell texts apart that differ in any character."""

from edgeloom.llm import merkle

TEXT = "go in the end. Now\tthe  second clause | and the third\n\n  a line of its own,\r\nthe last one " + "x" * 150


def roots(spark, texts):
    df = merkle.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "f")
    return {r["i"]: r["f"].split(" ")[0] for r in df.collect()}


def test_every_change_of_one_character_changes_the_root(spark):
    texts = [TEXT]
    for k in range(len(TEXT)):
        texts += [TEXT[:k] + c + TEXT[k + 1 :] for c in (" ", "\t", "\n", "\x01", "|", "e") if c != TEXT[k]]
        texts += [TEXT[:k] + TEXT[k + 1 :], TEXT[:k] + " " + TEXT[k:], TEXT[:k] + "\x01" + TEXT[k:]]
    texts = sorted(set(texts))
    assert len(set(roots(spark, texts).values())) == len(texts)


def test_blanks_and_control_characters_count(spark):
    texts = ["go in the end. Now", "go in   the end.\t Now", "and the", "and\x01the", "", " ", "\n", "foo. bar", "foo.  bar", "foo.\tbar", "été 日本語. ", "été 日本語."]
    assert len(set(roots(spark, texts).values())) == len(texts)


def test_leaves_are_the_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(TEXT.replace("\n", "¶"),), ("日本語のテキスト" * 40,), ("",)], "t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(merkle.LEAF), F.lit(0)).alias("leaves")).collect()
    assert all("".join(r["leaves"]) == r["t"] and all(len(x) <= 2 + merkle.MOST for x in r["leaves"]) for r in got)


def test_very_long_text_and_shared_parts(spark):
    from pyspark.sql import functions as F

    words = [f"word{i % 977}t" for i in range(100_000)]
    other = words[:60_000] + ["new"] + words[60_000:]
    df = spark.createDataFrame([(" ".join(words), " ".join(other))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    row = df.select((F.substring("fa", 1, 32) == F.substring("fb", 1, 32)).alias("same"), merkle.likeness(merkle.leaves(F.col("fa")), merkle.leaves(F.col("fb"))).alias("n")).head()
    assert not row["same"] and row["n"] > 0.99
