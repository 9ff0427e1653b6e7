import os
import tempfile

from conftest import SF001
from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.operators import vocab as V


def test_vocab_ids_and_unknowns(spark):
    df = spark.createDataFrame([("a a a b b c",), ("a d",)], "text string")
    vocab = {r.word: r.id for r in V.build_vocab(df, 2).collect()}
    assert vocab == {"a": 16, "b": 17}
    ids = [r.input_ids for r in V.tokenize_with_vocab(df, V.build_vocab(df, 2), keys=["text"]).orderBy("text").collect()]
    assert ids == [[16, 16, 16, 17, 17, 1], [16, 1]]


def test_tokenizer_file_hook_matches_local_encoding(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    docs = inputs.table(spark, SF001, "documents").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").limit(20).collect()]  # a small training fixture
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=300, special_tokens=["[UNK]"]))
    path = os.path.join(tempfile.mkdtemp(prefix="tokenmill-tok-"), "tokenizer.json")
    tok.save(path)
    out = V.tokenize_with(docs, V.tokenizer_file_hook(spark, path), out="ids")
    got = {r.doc_id: r.ids for r in out.collect()}
    want = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert got == want
    assert all(len(v) > 0 for v in got.values())


def test_whole_vocabulary_equals_a_plain_count(spark):
    from collections import Counter
    docs = inputs.table(spark, SF001, "documents")
    want = Counter(w for r in docs.collect() for w in V.re.findall(V.WORD_PATTERN, r.text))
    order = sorted(want, key=lambda w: (-want[w], w.encode()))
    got = {r.word: r.id for r in V.build_vocab(docs).collect()}
    assert got == {w: V.FIRST_WORD_ID + i for i, w in enumerate(order)}
    top = {r.word: r.id for r in V.build_vocab(docs, 700).collect()}
    assert top == {w: got[w] for w in order[:700]}


def test_vocab_ids_with_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (None, "b z")],
                               "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 16), ("b", 17)], "word string, id long")
    got = sorted(((r.doc_id, r.ids) for r in V.tokenize_with_vocab(df, vocab, out="ids").collect()), key=str)
    assert got == sorted([(1, [16, 17, 16]), (1, [16, 17, 16]), (2, []), (3, []), (None, [17, 1])], key=str)


def test_vocab_ids_do_not_depend_on_the_head(spark):
    docs = inputs.table(spark, SF001, "documents").select("doc_id", "text")
    vocab = V.build_vocab(docs, 900)
    want = None
    for head in (0, 10, 900, 10_000):
        got = sorted((r.doc_id, r.ids) for r in V.tokenize_with_vocab(docs, vocab, out="ids", head=head).collect())
        want = want or got
        assert got == want
    ids = {r.word: r.id for r in vocab.collect()}
    assert dict(want) == {r.doc_id: [ids.get(w, V.UNK_ID) for w in V.re.findall(V.WORD_PATTERN, r.text)] for r in docs.collect()}


def test_vocab_ids_shuffle_a_row_per_rare_word_and_no_text(spark):
    docs = spark.createDataFrame([(i, " ".join(["the a"] * 200 + [f"w{i} w{i} w{i}"])) for i in range(20)], "doc_id long, text string").repartition(2)
    vocab = V.build_vocab(docs)
    df = V.tokenize_with_vocab(docs, vocab, head=2)
    assert sorted(len(r.input_ids) for r in df.collect()) == [403] * 20
    plan = df._jdf.queryExecution().executedPlan()
    import re
    text = plan.toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert shuffles and all("text" not in s for s in shuffles)
    assert not re.search(r"Python|Pandas", text)


def test_hook_gets_bounded_batches_of_text(spark):
    """An Arrow batch has up to 10,000 rows; the ids of all its texts aren't held at once."""
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 7, F.repeat(F.lit("ab "), 5000)).alias("text"))
    out = V.tokenize_with(docs, lambda texts: [[len(texts), sum(map(len, texts)), len(t)] for t in texts], out="ids").collect()
    assert sorted((r.doc_id, r.ids[2]) for r in out) == [(i, 0 if i == 7 else 15000) for i in range(400)]
    assert max(r.ids[1] for r in out) <= V.HOOK_BYTES and max(r.ids[0] for r in out) > 1


def test_hook_must_give_a_result_for_every_text(spark):
    import pytest
    docs = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="1 results for 2 texts"):
        V.tokenize_with(docs, lambda texts: [[1]]).collect()


def test_vocab_ids_make_no_row_per_word_occurrence(spark):
    """Rare, very long and unknown words, copies in several partitions, keys of odd names."""
    long = "x" * (V.HEAD_CHARS + 1)
    texts = [f"the a r{i % 7} {long} the r{i % 5} new{i}" for i in range(30)] + ["the r1 a r1 r2"] * 20 + [None, "", " \t"]
    docs = spark.createDataFrame([(i, "q", t) for i, t in enumerate(texts)], "t long, ids string, text string").repartition(5)
    words = ["the", "a", long, *[f"r{i}" for i in range(7)]]
    vocab = spark.createDataFrame([(w, 16 + i) for i, w in enumerate(words)], "word string, id long")
    df = V.tokenize_with_vocab(docs, vocab, keys=["t", "ids"], out="rare", head=3)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    ids = {w: 16 + i for i, w in enumerate(words)}
    want = [(i, "q", [ids.get(w, V.UNK_ID) for w in (t or "").split()]) for i, t in enumerate(texts)]
    assert sorted((r.t, r.ids, r.rare) for r in df.collect()) == want
