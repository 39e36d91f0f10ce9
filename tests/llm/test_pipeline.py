"""The corpus pipeline against plain versions of its stages; null and repeated doc_ids, empty tables."""

import random
from collections import defaultdict

import corpus_pipeline
from pennybrook.llm import langid

from . import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, item = (" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(60)) for _ in range(4))
    docs = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (None, item), (4, item)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).repartition(3)
    near = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert sorted(map(repr, near.select("doc_id", "text").toLocalIterator())) == sorted(map(repr, spark.createDataFrame([(1, a), (None, b), (3, c), (4, item)], "doc_id long, text string").collect()))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()
    assert sorted(r["text"] for r in left) == sorted([a] * 4 + [b] * 2 + [c])


def speech(rng, lang, n):
    stems = {"en": ["the", "ing", "tion", "with", "that"], "de": ["der", "ung", "schr", "und", "über"]}[lang]
    return " ".join(rng.choice(stems) + rng.choice("abcdefghij") + rng.choice(stems) for _ in range(n))


def test_run_is_what_plain_stages_give(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(12)
    line = lambda lang: speech(rng, lang, rng.randint(6, 14))
    common = ["All rights are reserved by the owners of this page.", line("en")]
    docs = {}
    for i in range(1, 61):
        lang = ("en", "de")[i % 2]
        docs[i] = "\n".join(rng.choice(common) if rng.random() < 0.2 else line(lang) for _ in range(rng.randint(1, 6)))
    for i in range(61, 76):  # near copies: a changed word, or the same words on other lines
        words = docs[i - 60].split(" ")
        at = rng.randrange(len(words))
        docs[i] = " ".join([*words[:at], "changed" + str(i), *words[at + 1 :]]) if i % 2 else docs[i - 60].replace("\n", " ")
    items = [speech(rng, "en", 25), "five words are an item", speech(rng, "de", 12)]
    docs |= {80: line("en") + " " + items[0], 81: "now " + items[1].upper() + ", he said " + line("en"), 82: line("de") + "\n" + items[2], 83: " ".join(items[2].split()[:9]) + " " + line("de"), 84: speech(rng, "en", 3000)}
    docs |= {85 + i: docs[i + 1] for i in range(5)}  # exact copies
    rows = [(d, t, ("en", "de")[d % 2] if d < 61 else None, "s", len(t)) for d, t in docs.items()] + [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "12 34 ...", "en", "s", 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert kept == docs  # no text, or no letter: rejected
    known = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(known[d] == ("en", "de")[d % 2] for d in range(1, 61))
    left = plain.decontaminated(plain.near_dedup(plain.line_dedup(docs)), items)
    assert len(left) < len(docs) - 10 and not {80, 81, 82} & set(left) and {83, 84} <= set(left)

    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = plain.pieces(left, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    assert sorted(r[:5] for r in got) == sorted(want) and any(r[1] for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r[3] for r in got) // 2048) + 1


def test_stages_on_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS)
