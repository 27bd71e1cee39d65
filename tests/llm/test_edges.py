"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from meltfield.llm import op01_langid, op02_pii, op03_substring, op04_quality, op05_decontam, op06_tokens, op07_bpe, op08_simhash, op09_toxicity, op10_html

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("h", "fp", "k", "at", "label", "item_id", "n_tokens", "score", "component_id", "ids", "variant", "h1", "line", "payload", "part", "label_id", "kept_id", "bad_id")
LONG = "Lorem ipsum dolor sit amet consectetur " * 30_000


def rows(extra=()):
    out = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (5, "the quick brown fox jumps over the lazy dog", "en", "a"), (6, "the quick brown fox jumps over the lazy dog", "en", "b"), (None, "no id here, mail me@example.com now", None, None),
        (7, LONG, "en", "a"), (8, "\x00\x1c   é😀 <|endoftext|> +1 (555) 555-0100", "fr", "a"), (9, "4111 1111 1111 1111 and 10.0.0.1", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in [*out, *extra]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "brown fox jumps over the lazy"), (2, None), (3, ""), (4, "one"), (None, "quick brown fox jumps over the"), (1, "brown fox jumps over the lazy")], "item_id long, text string")


V7, V6 = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PER_ROW = {
    "op1": lambda d, x: op01_langid.digest(op01_langid.predict(d, op01_langid.fit(d))),
    "op2": lambda d, x: op02_pii.digest(op02_pii.detect(d)),
    "op3": lambda d, x: op03_substring.digest(op03_substring.dedup(d)),
    "op4": lambda d, x: op04_quality.digest(op04_quality.assess(d, op04_quality.fit(d, x["labels"]))),
    "op6": lambda d, x: op06_tokens.digest(op06_tokens.read(op06_tokens.write(d, V6))),
    "op7": lambda d, x: op07_bpe.digest(op07_bpe.encode(d, V7)),
    "op8": lambda d, x: op08_simhash.digest(op08_simhash.near_duplicates(d)),
    "op9": lambda d, x: op09_toxicity.grade(d, op09_toxicity.fit(d, x["labels"])),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(name, docs, clashing, empty, labels):
    got = PER_ROW[name](docs, {"labels": labels}).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows()), key=str)
    columns = got[0].asDict().keys()
    again = PER_ROW[name](clashing, {"labels": labels}).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert PER_ROW[name](empty, {"labels": labels.where("false")}).count() == 0


def test_decontamination(docs, clashing, empty, benchmark):
    for d in (docs, clashing):
        got = sorted(((r["doc_id"], r["item_id"], r["containment"]) for r in op05_decontam.digest(op05_decontam.contaminated(d, benchmark)).collect()), key=str)
        assert got == sorted([(4, 4, 1.0)] + [(i, j, 1.0) for i in (5, 5, 6) for j in (1, None)], key=str)
    assert op05_decontam.contaminated(empty, benchmark).count() == 0
    assert op05_decontam.contaminated(docs, benchmark.where("false")).count() == 0
    left = op05_decontam.clean(docs, benchmark)
    assert left.columns == docs.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([1, 2, 3, 7, 8, 9, None], key=str)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a</p>"), (3, "u", "<div>" * 3000 + "x"), (3, "u", "<p>same"), (3, "u", "<p>same")], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in op10_html.digest(op10_html.extract(pages)).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "a", 1), (3, "u", "x", 1), (3, "u", "same", 4), (3, "u", "same", 4)], key=str)
    assert op10_html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, docs, clashing, empty, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    f, last = dict(corpus_pipeline.STAGES)[stage], corpus_pipeline.STAGES[-1][0]
    out = f(spark, docs, str(tmp_path))
    if stage != last:
        assert out.columns == docs.columns and [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]
        assert f(spark, clashing, str(tmp_path)).columns == clashing.columns
    assert 0 < out.count() <= docs.count()
    assert f(spark, clashing, str(tmp_path)).count() == out.count()
    assert f(spark, empty, str(tmp_path)).count() == 0


def test_one_row_of_each_near_duplicate_group_stays(spark, clashing):
    a, b, c = ("the quick brown fox jumps over the lazy dog", "an entirely different sentence about slow green turtles", "numbers and letters meet in a third unrelated line of words")
    texts = [(5, a), (5, a), (6, a), (5, b), (4, b), (None, b), (None, c), (None, c), (None, c), (8, None), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", str(n), 0) for n, (i, t) in enumerate(texts)], DOCS).repartition(5)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in left.collect()), key=str) == sorted([(5, a), (4, b), (None, c), (8, "")], key=str)
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, clashing, "").collect()]
    assert sorted(ids, key=str) == sorted([1, 4, 5, 7, 8, 9, None], key=str)


@pytest.mark.parametrize("item", [1, None])
def test_texts_under_one_item_id_are_items_of_their_own(item, spark):
    passages = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    bench = spark.createDataFrame([*((item, p) for p in passages), (item, passages[0].upper()), (item, "one")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {p} after") for i, p in enumerate(passages)] + [(9, "nothing of it")], "doc_id long, text string")
    got = sorted(tuple(r) for r in op05_decontam.digest(op05_decontam.contaminated(docs, bench)).collect())
    assert got == [(i, item, 26, 26, 1.0) for i in range(3)]
    assert [r["doc_id"] for r in op05_decontam.clean(docs, bench).collect()] == [9]


@pytest.mark.parametrize("key", [5, None])
def test_a_contaminated_row_takes_no_other_row_of_its_id(key, spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(key, f"some {item} words"), (key, "clean words"), (key, "clean words"), (key, None), (key, f"other {item}"), (6, "clean")], "doc_id long, text string").repartition(3)
    left = sorted((tuple(r) for r in op05_decontam.clean(docs, bench).collect()), key=str)
    assert left == sorted([(key, "clean words"), (key, "clean words"), (key, None), (6, "clean")], key=str)


def _low_bits_meet(spark):
    """Two texts of 60 words without a common window whose 64-bit hashes agree in their low 16 bits."""
    texts = spark.range(3000).select(F.concat_ws(" ", *(F.concat(F.lit(f"w{j}x"), "id") for j in range(60))).alias("text"))
    seen = {}
    for text, low in texts.select("text", F.xxhash64("text").bitwiseAND(F.lit(0xFFFF))).collect():
        if low in seen:
            return seen[low], text
        seen[low] = text


@pytest.mark.parametrize("key", [5, None])
def test_substring_tells_texts_under_one_id_apart(key, spark):
    a, b = _low_bits_meet(spark)
    docs = spark.createDataFrame([(1, " ".join(a.split()[10:40])), (key, a), (key, b), (key, b)], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["kept"]): r["n_removed"] for r in op03_substring.dedup(docs).collect()}
    assert got == {(1, " ".join(a.split()[10:40])): 0, (key, " ".join(a.split()[:10] + a.split()[40:])): 30, (key, b): 0}


def test_substring_finds_a_repeat_between_texts_under_one_id(spark):
    same = " ".join(f"s{i}" for i in range(25))
    # the hash is of the whole text, so texts that share their start and their low bits are searched for
    texts = spark.range(3000).select(F.concat(F.lit(same + " "), F.col("id").cast("string")).alias("text"))
    pairs = texts.groupBy(F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("low")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    got = sorted(r["n_removed"] for r in op03_substring.dedup(spark.createDataFrame([(None, t) for t in pairs], "doc_id long, text string")).collect())
    assert got == [0, 25]


@pytest.mark.parametrize("key", [7, None])
def test_rows_of_one_id_are_dealt_by_their_texts(key, spark, monkeypatch):
    monkeypatch.setattr(op06_tokens, "HOT_ROWS", 20)
    texts = [f"text {i} of one id" for i in range(60)]
    docs = spark.createDataFrame([(key, t) for t in texts] + [(1, "first")], "doc_id long, text string").repartition(3)
    frames = op06_tokens.write(docs, V6)
    assert frames.select("part").distinct().count() > 1
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in op06_tokens.read(frames).collect())
    assert len(got) == 61 and got[0][2] == 1 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_equal_totals_go_to_the_first_language(spark):
    model = op01_langid.train(["aaa bbb", "ccc ddd"], ["x", "y"])
    got = {r["doc_id"]: r["lang_pred"] for r in op01_langid.predict(spark.createDataFrame([(1, "aaa " * 12 + "ccc " * 12), (2, "ccc " * 12 + "aaa " * 12), (3, "zzz")], "doc_id long, text string"), model).collect()}
    assert got == {1: "x", 2: "x", 3: "x"}


def test_ideographs_are_words_and_marks_belong_to_them(spark):
    model = op01_langid.train(["这是一个中文句子我们" * 5, "これはにほんごのぶんです" * 5, "the house and the garden " * 5, "tiếng việt là ngôn ngữ " * 5], ["zh", "ja", "en", "vi"])
    text = "这是中文句子我们这是中文句子 the house and the garden the house"
    (row,) = op01_langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s["lang"], text[s["start"] : s["end"]]) for s in row["spans"]] == [("zh", text[:14]), ("en", text[15:])]
    (row,) = op01_langid.predict(spark.createDataFrame([(1, "ngôn ngữ — “tiếng việt”")], "doc_id long, text string"), model).collect()
    assert row["lang_pred"] == "vi" and row["score"] == 1.0
