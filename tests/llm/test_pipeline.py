"""The pipeline against a brute-force version of its stages, and the registration of its queries."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tests_words import near_groups, words
from tokenizers import Tokenizer

from tidewatch.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, path):
    rng = random.Random(9)
    voc = {"en": ["the", "of", "and", "thing", "ation", "with"], "fr": ["le", "été", "que", "aux", "oi", "ment"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append([i, " ".join("".join(rng.choices(voc[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 120))), lang, f"s{i % 5}", 0])
    for i in range(120, 150):  # near copies, a word changed
        base = rows[(i * 7) % 110]
        w = base[1].split()
        w[len(w) // 2] = "changed"
        rows.append([i, " ".join(w), base[2], f"s{i % 5}", 0])
    rows += [[150, rows[3][1], "en", "s0", 0], [151, None, None, None, None], [152, "", "en", "s1", 0], [153, "123 456", None, "s1", 7], rows[5], [154, "word " * 3000, "en", None, 0]]
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    lettered = Counter(tuple(r) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert Counter(map(tuple, out[0])) == lettered
    groups = near_groups([(r.doc_id, r.text) for r in out[0]], 0.8)
    assert sorted(r.doc_id for r in out[1]) == sorted(groups) and len(out[1]) < len(out[0])
    size, taken = Counter(), Counter()
    for r in out[1]:
        size[r.source] += len(words(r.text))
    for r in out[2]:
        taken[r.source] += len(words(r.text))
    times = Counter(r.doc_id for r in out[2])
    assert set(times) <= {r.doc_id for r in out[1]} and max(times.values()) <= 3
    assert all(taken[s] <= 3 * size[s] for s in size) and 0.8 < sum(taken.values()) / sum(size.values()) < 1.2
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in out[2])
    assert sum(r.length for r in out[3]) == tokens
    filled = Counter()
    for r in out[3]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-tokens // 2048) + 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r)[:5] for r in whole.collect()) == Counter(tuple(r)[:5] for r in out[3])


def test_stages_keep_extra_columns_of_any_name(spark, tmp_path):
    rows = [(1, "the first text of these has some words in it", "en", "a", 1), (2, "un autre texte avec des mots dedans et plus", "fr", None, 2), (2, "un autre texte avec des mots dedans et plus", "fr", None, 2), (None, "the third text of them has other words too", "en", "b", 3), (5, None, None, "b", 4), (6, "", None, "b", 5), (7, "12 !", None, "b", 6)]
    clashing = ["key", "copies", "size", "rate", "kept", "bands", "lang_pred", "ambiguous", "__text", "row_id", "copy", "target", "rank", "stratum", "start"]
    docs = spark.createDataFrame([(*r, *[f"{c}{i}" for c in clashing]) for i, r in enumerate(rows)], ", ".join([SCHEMA, *(f"`{c}` string" for c in clashing)]))
    names = docs.columns
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == {1, 2, None}
    alone = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert alone.columns == names and sorted(str(r.doc_id) for r in alone.collect()) == ["1", "2", "5", "6", "7", "None"]
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == names and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
    packed = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in packed) == ["1", "2", "2", "5", "6", "7", "None"]


def test_no_label_keeps_what_has_a_letter(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 1), (2, "12 !", None, "a", 1), (3, None, None, "a", 1), (4, "és", None, "a", 1)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) == {"op1_license_scan", "op8_source_mixing", "op13_url_filters"}
