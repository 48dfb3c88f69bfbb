"""Semantics on small fixtures, without SQL twins."""

import hashlib
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import bpe_training, corpus, metrics, order, sampling, sft, tokens
from lexmill.sources import readers


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("sentence", "bad"),
    [("Il est né le  à Lyon.", True), ("La fin du .", True), ("Une phrase (, vide).", True), ("Il va vers , puis part.", True), ("Le <b>mot</b> reste.", True), ("Une bonne phrase ; vraiment, 3,5 fois.", False), (None, None)],
)
def test_defects(spark, sentence, bad):
    assert one(spark, sentence, tx.defective) is bad


def test_article_drops_defects_headings_and_tail(spark):
    good = "Cette phrase est assez longue pour rester dans le texte final. " * 3
    text = f"Titre\n{good}Né le  à Paris.\nSection\n{good}{good}\nVoir aussi :\n{good}"
    out = one(spark, text, lambda c: tx.article(tx.judged_lines(c)))
    assert out and "Né le" not in out and "Titre" not in out and "Voir aussi" not in out and out.count("\n\n") == 1


@pytest.mark.parametrize(("n", "kept"), [(399, False), (400, True)])
def test_web_length(spark, n, kept):
    assert (one(spark, "a" * n, tx.web_page) is not None) is kept


def test_dialogue(spark):
    found = one(spark, "[A:] un [B :] deux [A:]   [C:] trois", tx.dialogue)
    assert [(m.role, m.content) for m in found] == [("user", "un"), ("assistant", "deux")]
    assert one(spark, "sans marque", tx.dialogue) is None


def test_window_holds_the_answer(spark):
    context = " ".join(f"Phrase numéro {i} du contexte." for i in range(120))
    for answer in ("numéro 1 ", "numéro 60", "numéro 119"):
        at = context.index(answer)
        w = spark.createDataFrame([(context, at, len(answer))], "c string, a int, n int").select(tx.qa_window("c", "a", "n")).first()[0]
        assert answer.strip() in w and len(w) < 1000


def test_first_wins_collapses_equal_beginnings(spark):
    head = "x" * 600
    rows = [("a", 0, 1, head + "1"), ("b", 1, 0, head + "2"), ("b", 1, 1, head + "33"), ("c", 2, 0, None), ("c", 2, 1, None)]
    df = spark.createDataFrame(rows, "src string, src_rank int, ord int, text string")
    assert sorted((r.src, r.ord) for r in corpus.first_wins(df).collect()) == [("a", 1), ("b", 1), ("c", 0), ("c", 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sum_any_partitioning(spark, parts):
    df = spark.range(1000).repartition(parts).select(F.col("id").alias("ord"), (F.col("id") % 5).alias("n"))
    got = {r["ord"]: r["s"] for r in order.running_sum(df, "ord", "n", "s", bucket=64).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 5


@pytest.mark.parametrize(("length", "offset"), [(8, 0), (8, 3), (5, 17)])
def test_blocks_cover_the_stream(spark, length, offset):
    docs = [(i, list(range(i * 100, i * 100 + (i * 7) % 13))) for i in range(40)]
    stream = [t for _, d in docs for t in d][offset:]
    whole = sum(len(d) for _, d in docs)
    df = spark.createDataFrame(docs, "ord long, ids array<int>")
    got = {r.block_id: (r.x, r.y) for r in tokens.blocks(df, length, offset=offset).collect()}
    full = [b for b in range(whole // length - 1) if (b + 1) * length + 1 <= len(stream)]
    for b in full:
        assert got[b] == (stream[b * length : b * length + length], stream[b * length + 1 : b * length + length + 1])


def test_chat_mask(spark):
    m = [("user", " Oui ? "), ("assistant", "Non"), ("user", "a"), ("assistant", "")]
    ids, mask = tokens.encode_chat(F.col("m"))
    df = spark.createDataFrame([(m,)], "m array<struct<role string, content string>>")
    r = df.select(ids.alias("i"), mask.alias("k")).first()
    masked = [i for i, k in zip(r.i, r.k, strict=True) if k]
    assert len(r.i) == len(r.k) and r.i[0] == tokens.USER
    assert masked == [5 + b for b in b"Non"] + [tokens.END, tokens.END]
    ids, mask = tokens.encode_chat(F.col("m"), prompt=True)
    r = df.select(ids.alias("i"), mask.alias("k")).first()
    assert r.i[-1] == tokens.ASSISTANT and r.k[-1] == 0


def test_ngram_ban(spark):
    assert one(spark, [1, 2, 3, 1, 2], lambda c: sampling.banned(c, 3), "array<int>") == [3]
    assert one(spark, [1, 2, 3], lambda c: sampling.banned(c, 3), "array<int>") == []


def test_sampling_filters(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([5.0, 4.0, 1.0, 0.5, 0.1, -3.0])], "step int, token_id int, logit double")
    ids = lambda d: sorted(r.token_id for r in d.collect())
    assert ids(sampling.best(df)) == [0]
    assert ids(sampling.top_k(df, 2)) == [0, 1]
    assert ids(sampling.top_p(sampling.softmax(df), 0.5)) == [0]
    assert ids(sampling.masked(df, 3, (0,))) == [1, 2]
    history = spark.createDataFrame([(0, [0])], "step int, generated array<int>")
    assert ids(sampling.best(sampling.penalised(df, history, 10.0))) == [1]


@pytest.mark.parametrize(("p", "r", "f1"), [("", "", 1.0), ("le", "", 1.0), ("chat", "", 0.0), ("Le chât noir", "chat noir", 1.0), ("a a b", "a b b", 2 / 3)])
def test_f1(spark, p, r, f1):
    df = spark.createDataFrame([(p, r)], "p string, r string").select(metrics.answer_tokens(F.col("p")).alias("p"), metrics.answer_tokens(F.col("r")).alias("r"))
    assert math.isclose(df.select(metrics.token_f1(F.col("p"), F.col("r"))).first()[0], f1)


def test_persona(spark):
    df = spark.createDataFrame([("Qui es-tu ?", "x"), ("Bonjour", "En tant qu’IA, je"), ("Bonjour", "OpenAI"), ("Capitale ?", "Paris")], "q string, a string")
    assert [r[0] for r in df.select(sft.about_identity(F.col("q"), F.col("a"))).collect()] == [True, True, True, False]


def test_checkpoints(spark):
    df = spark.createDataFrame([(f"ckpt_{i:07d}.pt",) for i in (2000, 10000, 300, 99999)], "path string")
    assert sorted(r["it"] for r in metrics.checkpoints(df, 2).where("kept").collect()) == [10000, 99999]
    assert metrics.checkpoints(df, 0).where("kept").count() == 4


def recounted(words, most, least=2):
    """Merges by counting all pairs afresh for each."""
    parts = {w: [bytes([b]) for b in w.encode()] for w in words}
    want = []
    while len(want) < most:
        pairs = Counter()
        for w, n in words.items():
            for pair in zip(parts[w], parts[w][1:], strict=False):
                pairs[pair] += n
        top = min(pairs, key=lambda x: (-pairs[x], x), default=None)
        if top is None or pairs[top] < least:
            break
        want.append(top)
        for w in words:
            made, i = [], 0
            while i < len(parts[w]):
                hit = tuple(parts[w][i : i + 2]) == top
                made.append(top[0] + top[1] if hit else parts[w][i])
                i += 1 + hit
            parts[w] = made
    return want


def drawn_words(seed, n=60):
    rng = random.Random(seed)
    return {"".join(rng.choices("aabcdé", k=rng.randint(1, 9))): rng.choice([1, 2, 2, 3, 5, 9]) for _ in range(n)} | {"aaaaaaa": 3, "abababab": 4}


def learned(spark, words, merges, parts=3, **more):
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(parts)
    return bpe_training.learn(rows, 5 + 256 + merges, **more)


@pytest.mark.parametrize(("seed", "parts", "listed"), [(1, 1, 512), (1, 5, 7), (2, 3, 512), (3, 2, 3)])
def test_merges_equal_recounting(spark, seed, parts, listed):
    words = drawn_words(seed)
    assert learned(spark, words, 25, parts, listed=listed) == recounted(words, 25)


def test_rounds_take_what_merging_one_by_one_would():
    """The same choice as recounting, merge by merge, on many small tables; and more than one a round where that is safe."""
    rounds = merges = 0
    for seed in range(150):
        words = drawn_words(seed, 25)
        parts = {w: [f"{b:02x}" for b in w.encode()] for w in words}
        done = []
        for listed in (512, 4):
            spelled, got = dict(parts), []
            while len(got) < 20:
                pairs = Counter()
                for w, n in words.items():
                    for pair in zip(spelled[w], spelled[w][1:], strict=False):
                        pairs[pair] += n
                top = sorted(((a, b, n) for (a, b), n in pairs.items() if n >= 2), key=lambda x: (-x[2], x[0], x[1]))[:listed]
                if not top:
                    break
                now = bpe_training.next_merges(top, len(top) < listed, 20 - len(got))
                assert now
                rounds, merges = rounds + 1, merges + len(now)
                got += now
                for a, b in now:
                    for w, p in spelled.items():
                        made, i = [], 0
                        while i < len(p):
                            hit = p[i : i + 2] == [a, b]
                            made.append(a + b if hit else p[i])
                            i += 1 + hit
                        spelled[w] = made
            done.append([(bytes.fromhex(a), bytes.fromhex(b)) for a, b in got])
        assert done[0] == done[1] == recounted(words, 20)
    assert merges > 1.3 * rounds


def test_long_words_are_merged_in_time():
    tokenizer = bpe_training.Tokenizer([(b"a", b"a"), (b"aa", b"aa"), (b"b", b"c"), (b"a", b"bc")])
    began = time.time()
    assert len(tokenizer.word("a" * 200_001)) == 50_001 and time.time() - began < 10
    spelled = lambda w: [tokenizer.spelled[i] for i in tokenizer.word(w)]
    assert spelled("aaaaabc") == [b"aaaa", b"abc"] and spelled("aaabc") == [b"aa", b"abc"] and spelled("") == []


def folded(text, size, least):
    """Paragraph by paragraph."""
    out, held = [], []
    for para in filter(None, (p.strip() for p in text.split("\n\n"))):
        held.append(para)
        if sum(map(len, held)) >= size:
            out.append("\n\n".join(held))
            held = []
    return out + (["\n\n".join(held)] if sum(map(len, held)) >= min(size, least) else [])


@pytest.mark.parametrize("split_bytes", [200, 1 << 20])
def test_chunks_of_files_in_many_splits(spark, tmp_path, split_bytes):
    from lexmill.operators import chunking

    rng = random.Random(3)
    files = {}
    for i in range(5):
        paras = ["".join(rng.choices("abc é\U0001f600\ufffd\ufdd0", k=rng.choice([0, 1, 9, 40, 300]))) + rng.choice(["", "\nline", " ", "\n \nx"]) for _ in range(rng.choice([1, 40]))]
        raw = rng.choice(["\n\n", "\n\n\n", "\r\n\r\n"]).join(paras).encode()
        for _ in range(12):  # ill-formed bytes anywhere between characters or inside them
            at = rng.randrange(len(raw) + 1)
            raw = raw[:at] + rng.choice([b"\xff", b"\xc3", b"\xe2\x82", b"\x80"]) + raw[at:]
        files[f"f{i}.txt"] = raw
    files["empty.txt"], files["blank.txt"], files["one.txt"] = b"", b"\n\n \n\n", b"x" * 700
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = readers.local_files(spark, [str(tmp_path)], 150).collect()
        assert split_bytes > 200 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        bare = chunking.chunked(chunking.paragraphs(chunking.lines(spark, [str(tmp_path)])), 60, 1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, raw in files.items():
        text = raw.decode(errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert [r.text for r in sorted(got, key=lambda r: r.chunk_no) if r.path.endswith("/" + name)] == folded(text, 150, 200), name
        assert [r.text for r in sorted(bare, key=lambda r: r.chunk_no) if r.file.endswith("/" + name)] == folded(text, 60, 1), name


def test_few_rows_more_than_asked_for_are_cleaned(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judged(i):
        seen.add(1)
        return f"row {i}" if i % 5 == 0 else None

    rows = spark.range(20_000).withColumnRenamed("id", "i")
    for most in (40, 700):
        before = seen.value
        got = corpus.survivors(rows, "t", most, 11, "i", lambda df: corpus.computed(df, "t", judged("i"))).collect()
        want = sorted((i for i in range(0, 20_000, 5)), key=lambda i: hashlib.md5(f"11:{i}".encode()).hexdigest())[:most]
        assert sorted(r.i for r in got) == sorted(want) and seen.value - before < 1.6 * 5 * most + 1200
    all_of_them = corpus.survivors(rows, "t", 5000, 11, "i", lambda df: corpus.computed(df, "t", judged("i")))
    assert all_of_them.count() == 4000


def test_texts_are_cleaned_once(spark):
    raw = spark.createDataFrame([(1, "x " * 300)], "id long, text string")
    for read in (lambda: readers.web(raw, None, 1), lambda: readers.articles(raw, None, 1)):
        plan = read().where("length(text) > 3").select(F.md5("text"), F.length("text"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("btrim") + plan.count("trim(both") == readers_trims(raw, read), plan


def readers_trims(raw, read):
    """How often one cleaning expression trims."""
    name = tx.web_page if "web" in read.__code__.co_names else lambda c: tx.article(tx.judged_lines(c))
    plan = raw.select(name(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("btrim") + plan.count("trim(both")


def test_what_a_source_gave_before_it_failed_stays(spark, tmp_path):
    rows = spark.range(50).withColumnRenamed("id", "ord")
    broken = lambda: rows.withColumn("x", F.when(F.col("ord") == 25, F.raise_error(F.lit("gone"))).otherwise(F.lit(1)))
    kept, errors = readers.guarded_parts(spark, "own", readers.in_parts(broken, "ord", 10, 50), rows.limit(0))
    assert sorted(r.ord for r in kept.collect()) == list(range(20))
    (error,) = errors.collect()
    assert (error.source, error.part, error.kept) == ("own", 2, 20) and "gone" in error.error
    whole, none = readers.guarded_parts(spark, "own", readers.in_parts(lambda: rows, "ord", 20, 50), rows.limit(0))
    assert whole.count() == 50 and none.count() == 0
    empty, one = readers.guarded_parts(spark, "own", [lambda: spark.read.parquet(str(tmp_path / "none"))], rows.limit(0))
    assert empty.count() == 0 and one.count() == 1


def test_files_and_guards(spark, tmp_path):
    (tmp_path / "a.txt").write_text("un\n\n" + "deux" * 100 + "\n\ntrois")
    assert [r.text for r in readers.local_files(spark, [str(tmp_path)], 300).collect()] == ["un\n\n" + "deux" * 100]
    (tmp_path / "q.jsonl").write_text('{"question": "Q ?", "answer": " R "}\n{"question": "", "answer": "x"}\n{"messages": [{"role": "user", "content": "c"}]}\n')
    found = readers.user_jsonl(spark, str(tmp_path / "q.jsonl")).collect()
    assert sorted([(m.role, m.content) for m in r.messages] for r in found) == [[("user", "Q ?"), ("assistant", "R")], [("user", "c")]]
    empty = spark.createDataFrame([], "s string")
    assert readers.guarded("broken", lambda: spark.read.parquet(str(tmp_path / "none")), empty) is empty
    with pytest.raises(ValueError, match="empty"):
        readers.verified(spark.createDataFrame([], "ids array<int>"), 64)
    with pytest.raises(ValueError, match="vocabulary"):
        readers.verified(spark.createDataFrame([([70],)], "ids array<int>"), 64)
    with pytest.raises(ValueError, match="context"):
        readers.compatible(64, 64, 600, 512)


def test_tokenizer_round_trip(spark):
    texts = ["Été à l'hôtel, 1234 fois !", "<|end|> é \U0001f600", "", "aujourd'hui\n\nhier", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokenizer = bpe_training.Tokenizer(recounted({"aujourd": 5, "hui": 4, " fois": 3, "tel": 3}, 12))
    got = [r[0] for r in df.select(tokenizer.encode_col(F.col("text"))).collect()]
    assert [tokenizer.decode(ids) for ids in got] == [(t or "").replace("<|", "< |") for t in texts]
    assert all(i >= tokens.FIRST_BYTE for ids in got for i in ids) and len(tokenizer.word("1")) == 1
    assert tokenizer.missing(["<|end|>", "<|none|>"]) == ["<|none|>"]


def test_replies(spark):
    rows = [
        ("p", None, "prompter", "fr", "Une question ?", None), ("q", None, "prompter", "en", "A question?", None),
        ("a", "p", "assistant", "fr", "Une réponse.", 0), ("b", "p", "assistant", "fr", "Une autre.", None), ("c", "p", "assistant", "fr", "Moins bonne.", 1),
        ("d", "q", "assistant", "fr", "Parent étranger.", 0), ("e", "none", "assistant", "fr", "Sans parent.", 0), ("f", "p", "assistant", "fr", "ab", 0),
        ("g", "p", "assistant", "fr", "x" * 501, 0), ("h", "p", "assistant", "fr", "Je suis une IA", 0), ("i", "a", "assistant", "fr", "Suite.", 0),
    ]
    tree = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "message_id string, parent_id string, role string, lang string, text string, rank int, ord int")
    assert sorted(r.message_id for r in sft.replies(tree).collect()) == ["a", "b"]


def test_short_talks_keep_their_end(spark):
    talks = [(1, 0, "system", 5), (1, 1, "user", 40), (1, 2, "assistant", 10), (1, 3, "user", 10), (2, 0, "user", 90), (3, 0, "system", 5), (3, 1, "user", 90), (4, 0, "user", 5), (4, 1, "assistant", 90)]
    df = spark.createDataFrame(talks, "conv_id int, turn int, role string, n_tokens int")
    got = sorted((r.conv_id, r.turn) for r in sampling.truncated_history(df, 60, 20).collect())
    assert got == [(1, 0), (1, 3), (2, 0), (3, 0)]
    kept = {(r.conv_id, r.turn): r.n_kept for r in sampling.truncated_history(df, 60, 20).collect()}
    assert kept == {(1, 0): 5, (1, 3): 10, (2, 0): 39, (3, 0): 5}  # 60 - 20 - 1 of the long message
