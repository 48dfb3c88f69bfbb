"""Sinks and what reads them back, on small fixtures."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from lexmill import storage
from lexmill.operators import bpe_training, corpus, metrics, sft, tokens
from lexmill.sources import readers


def test_corpus_is_read_back(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.createDataFrame([("a é", None, "wiki", 0), ("b", None, "web", 1), (None, [("user", "q"), ("assistant", "r")], "chat", 2), ("c", None, "wiki", 3)], readers.RECORD)
    readers.write_corpus(rows, path)
    got = sorted((r.ord, r.src, r.text, len(r.messages or [])) for r in readers.records(spark, path).collect())
    assert got == [(0, "wiki", "a é", 0), (1, "web", "b", 0), (2, "chat", None, 2), (3, "wiki", "c", 0)]
    assert sorted(r.ord for r in readers.records(spark, path, stride=2).collect()) == [0, 2]


def test_streams_and_their_guards(spark, tmp_path):
    docs = spark.createDataFrame([("train", i, list(range(i % 5 + 1))) for i in range(40)] + [("val", 50, [1, 2, 3, 4, 5, 6, 7, 8, 9])], "split string, ord long, ids array<int>")
    path = str(tmp_path / "stream")
    readers.write_stream(docs, path)
    at, want = 0, {}
    for i in range(40):
        want["train", i] = at
        at += i % 5 + 1
    want["val", 50] = 0
    assert {(r.split, r.ord): r.offset for r in readers.read_stream(spark, path, 8).collect()} == want
    with pytest.raises(ValueError, match="training tokens"):
        readers.read_stream(spark, path, 100)
    with pytest.raises(ValueError, match="validation tokens"):
        readers.read_stream(spark, path, 9)


def test_examples_and_their_guards(spark, tmp_path):
    rows = spark.createDataFrame([("train", i, [1] * (i + 2), [0] * (i + 1) + [1]) for i in range(7)] + [("val", 9, [1, 2], [0, 1])], "split string, ord long, ids array<int>, mask array<tinyint>")
    path = str(tmp_path / "examples")
    stats = {r.split: tuple(r)[1:] for r in readers.write_examples(rows, path).collect()}
    assert stats == {"train": (7, sum(range(2, 9)), 7), "val": (1, 2, 1)}
    assert sorted(r.offset for r in readers.read_examples(spark, path, "train", 3, 2).collect()) == [0, 2, 5, 9, 14, 20, 27]
    with pytest.raises(ValueError, match="7 training examples"):
        readers.read_examples(spark, path, "train", 4, 2)
    assert readers.read_examples(spark, path, "val", 4, 2).count() == 1


def test_manifest_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "meta.json")
    assert not readers.exists(spark, path) and readers.read_manifest(spark, path) is None
    for values in ({"vocab": 1, "name": "é"}, {"vocab": 2, "sources": {"wiki": 3}}):
        readers.write_manifest(values, spark, path)
        assert readers.exists(spark, path) and readers.read_manifest(spark, path) == values
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["meta.json"]


def test_log_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, readers.LOG)
    readers.append_log(rows(("train", 1, 3.0, None, None, None, 0.1, 1.0, 10.0, 100, 1.0, 0), ("eval", 1, None, 2.5, 2.5, True, None, None, None, None, None, 1)), path)
    readers.append_log(rows(("eval", 2, None, 2.0, 2.0, True, None, None, None, None, None, 2), ("eval", 2, None, 2.2, 2.0, False, None, None, None, None, None, 3)), path)
    log = readers.read_log(spark, path)
    assert log.count() == 4
    found = metrics.summary(metrics.last_of_each(log.where("type = 'eval'"))).first()
    assert (found.min_loss, found.min_it, found.last_loss) == (2.2, 2, 2.2)


def test_few_validation_tokens_are_warned_about(spark, caplog):
    docs = spark.createDataFrame([("train", [1, 2]), ("val", [3])], "split string, ids array<int>")
    with caplog.at_level(logging.WARNING):
        readers.verified(docs, 64)
    assert "only 1 validation tokens" in caplog.text


def test_own_files_prefer_questions_and_answers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"instruction": "I", "question": "Q", "output": "O", "answer": "A"}) + "\n" + json.dumps({"prompt": "P", "response": "R", "question": " "}) + "\n" + json.dumps({"query": "no", "completion": "no"}) + "\n")
    got = sorted([m.content for m in r.messages] for r in readers.user_jsonl(spark, str(tmp_path / "q.jsonl")).collect())
    assert got == [["P", "R"], ["Q", "A"]]


def test_instructions_need_an_instruction(spark):
    rows = [(1, "", "only input", "A long answer"), (2, "see http://x ###", None, "An answer"), (3, "ask", "more", "see http://x"), (4, "ask", " ", "ok ###"), (5, "ask", "more", "fine"), (6, "x" * 301, None, "fine"), (7, "ask", None, "no"), (8, "qui es-tu", None, "fine")]
    got = sft.instructions(spark.createDataFrame(rows, "id int, instruction string, input string, output string")).collect()
    assert sorted((r.id, r.question) for r in got) == [(2, "see http://x ###"), (5, "ask\n\nmore")]


def test_last_of_repeated_messages_counts(spark):
    rows = [("p", None, "prompter", "fr", "Ancienne ?", None, 0), ("a", "p", "assistant", "fr", "Une réponse.", 0, 1), ("p", None, "prompter", "fr", "Neuve ?", None, 2), ("b", "p", "assistant", "fr", "Première.", 0, 3), ("b", "p", "assistant", "fr", "Autre.", 2, 4), ("a", "p", "assistant", "en", "An answer.", 0, 5)]
    tree = spark.createDataFrame(rows, "message_id string, parent_id string, role string, lang string, text string, rank int, ord long")
    assert [tuple(r) for r in sft.replies(tree).collect()] == [("a", "Neuve ?", "Une réponse.")]
    assert sft.replies(tree, most=1, seed=3).count() == 1


def test_long_persona_is_left_out(spark):
    rows = spark.createDataFrame([("p", [1, 2, 3], [0, 1, 1]), ("q", [1] * 9, [0] * 8 + [1])], "src string, ids array<int>, mask array<tinyint>")
    got = sft.add_persona(rows.limit(0).withColumn("split", F.lit("val")), rows, 4, most=5).collect()
    assert [(r.src, r.split) for r in got] == [("p", "train")] * 4


def test_vocabulary_without_special_tokens_is_refused():
    tokenizer = bpe_training.Tokenizer([(b"a", b"b"), (b"ab", b"ab"), (b"ab", b"c")])
    rows = tokenizer.rows()
    again = bpe_training.Tokenizer.of(rows)
    assert again.rank == tokenizer.rank and again.spelled == tokenizer.spelled and again.word("ababc") == tokenizer.word("ababc")
    with pytest.raises(ValueError, match=r"<\|end\|>"):
        bpe_training.Tokenizer.of([r for r in rows if r["token"] != "<|end|>"])
    assert tokens.STOP == (tokens.END, tokens.EOT) and not set(tokens.STOP) & set(tokens.FORBIDDEN)


def test_raw_rows_are_counted(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "src string, text string")
    assert {r.src: (r.raw, r.kept) for r in corpus.raw_counts(rows, F.col("text")).collect()} == {"a": (2, 1), "b": (1, 0)}


def test_staged_tables_can_be_freed(spark):
    one = storage.stage(spark.range(5).toDF("x"), "free")
    two = storage.stage(one.where("x > 1"), "kept")
    storage.free(one)
    assert two.count() == 3 and not readers.exists(spark, one.staged_at)


def test_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
