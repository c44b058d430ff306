"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions
from tests_words import near_groups
from tokenizers import Tokenizer

from tidewatch.llm import edit_counts, embedding_dedup, hmm, imatch, language_id, licenses, mixing, near_dedup, packing, token_files

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    voc = {"en": ["the", "of", "and", "thing", "ation", "ering", "with"], "fr": ["le", "été", "que", "aux", "oi", "éau", "ment"], "de": ["der", "und", "ß", "keit", "ver", "über", "sch"]}
    out = []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, " ".join("".join(rng.choices(voc[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 150))) + ".", lang))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, lang, f"s{i % 4}" if i % 7 else None, len(t), "x", "y") for i, t, lang in texts]
    rows += [(90, None, None, "s0", None, "x", "y"), (91, "", "en", "s1", 0, "x", "y"), (None, texts[0][1], "en", "s1", 1, "x", "y"), (92, texts[3][1], None, "hot", 1, "x", "y")]
    rows += [(93, "word " * 4000, "en", "s1", 1, "x", "y"), (94, "12 34 !!", "en", None, 1, "x", "y"), (95, "<|endoftext|> a  b\n\n c", "en", "z", 1, "x", "y")]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_licenses(spark, none):
    mit = dict(licenses.LICENSES)["MIT"]
    british = mit.replace("sublicense", "sub-licence").replace(" ", "   ").replace("MIT License", "MIT Licence\r\nCopyright (c) 2019 Some One\nCopyright © 2020-2021 Others, Inc.\nAll rights reserved.\n\n")
    rows = [(1, british), (2, mit + " more"), (3, None), (4, ""), (5, "Copyright 2020 X"), (6, "hello\n  Licensed under the Apache Licence, version 2.0!\nAll Rights Reserved\nx"), (1, british)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.license_report(d).collect()
    assert [r["license_id"] for r in got if r["doc_id"] == 1] == ["MIT", "MIT"]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[2]["license_id"] is None and by[2]["digest"]
    assert by[3]["digest"] is None and by[4]["digest"] is None and by[5]["digest"] is None
    assert by[6]["notices"] == "All-rights-reserved,Apache-2.0"
    assert licenses.license_report(none).count() == 0
    clash = licenses.scan(d.withColumn("digest", d["text"]), licenses.catalogue(spark, licenses.LICENSES), [])
    assert clash.columns == ["doc_id", "text", "digest", "license_id", "notices"]


def test_packing(docs, none):
    got = [r.asDict() for r in packing.pack_documents(docs, BYTE, 0, 2048).collect()]
    t = tokenizer(BYTE)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        stops = list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)) if len(ids) > 2048 else [len(ids)]
        for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and len(at) == -(-sum(at.values()) // 2048)
    assert packing.pack_documents(none, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
    bins, seen = {}, Counter()
    for n, first, stop, sequence, each, offset in packing.plan(counts, capacity):
        for rank in range(first, stop):
            k = rank - first
            bins.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
            seen[n, rank] += 1
    assert seen == Counter((n, r) for n, c in counts.items() for r in range(c))
    for items in bins.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= capacity and sum(3 * n > capacity for _, n in items) <= 2
    assert sorted(bins) == list(range(len(bins)))


def test_language_id(docs, none, texts):
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == docs.count()
    for i, _, lang in texts:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and by[i]["lang_pred"] == lang and 0 <= by[i]["score"] <= 1
    assert [by[i]["lang_pred"] for i in (90, 91, 94)] == ["und"] * 3
    assert language_id.identify(none).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", functions.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 12, 40])
def test_codewords_differ(k):
    c = language_id.codewords(k)
    assert c.shape[0] == k and len({tuple(r) for r in c.tolist()}) == k


def test_near_dedup(spark, none):
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(2000)]
    rows, near = [], {}
    for g in range(12):
        base = rng.choices(voc, k=rng.choice([40, 200, 900]))
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 6):
            copy = list(base)
            for _ in range(len(base) * k // 200):
                copy[rng.randrange(len(copy))] = rng.choice(voc)
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(500, None), (501, None), (502, ""), (503, ""), (504, "a b"), (505, "A b"), (506, "long " * 30000), (507, "long " * 30001), (0, rows[0][1]), (None, rows[0][1]), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := toks(t)) else None, t) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, ta) in enumerate(sets):
        for j, (_, b, tb) in enumerate(sets[:i]):
            if ta is not None and (ta == tb or a and b and len(a & b) >= 0.8 * len(a | b)):
                near[i, j] = parent[find(i)] = find(j)
    groups = {}
    for i, (d, _, t) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    want = Counter()
    for i, (d, _, _) in enumerate(sets):
        ids = [x for x in groups[find(i)] if x is not None]
        want[d, min(ids) if ids else None] += 1
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.deduplicate(d.withColumn("source", d["text"]).where("text IS NOT NULL"), 0.8)
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == len(groups) - 3
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.deduplicate(none).count() == 0


def test_near_dedup_at_the_threshold(spark, monkeypatch):
    """Texts whose only near texts are a few members of a large group; tiles of a few rows."""
    monkeypatch.setattr(near_dedup, "TILE_BYTES", 8192)
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(4):
        texts = [rng.choices(voc, k=400)]
        for _ in range(120):
            copy = list(rng.choice(texts))
            for _ in range(rng.randint(1, 11)):
                copy[rng.randrange(len(copy))] = rng.choice(voc)
            texts.append(copy)
        rows += [(1000 * g + i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["kept"]} == set(near_groups(rows, 0.8))


def test_token_files(docs, none, tmp_path):
    t = tokenizer(WORD)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(token_files.token_files_round_trip(docs, WORD, 1).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files_round_trip(none, WORD, 1).count() == 0


def test_token_file_access_and_damage(tmp_path):
    import xxhash
    import zstandard

    path = tmp_path / "a.tok"
    with path.open("wb") as f:
        w = token_files.ShardWriter(f, 2)
        for d, ids in ((5, [1, 2, 3]), (None, []), (7, list(range(5000)))):
            w.append(d, np.array(ids, "<u4"))
        w.close()
    data = path.read_bytes()
    assert len(data) == w.written
    with path.open("rb") as f:
        r = token_files.ShardReader(f, len(data))
        assert r.doc_ids[r.nulls == 0].tolist() == [5, 7] and r.lengths.tolist() == [3, 0, 5000]
        assert next(r.read(2)).tolist() == list(range(5000)) and [x.tolist() for x in r.read(0, 2)] == [[1, 2, 3], []]
        assert r.table[0, 2] == xxhash.xxh64_intdigest(np.array([1, 2, 3], "<u2").tobytes()) & 0xFFFFFFFF
    stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)  # skippable frames are skipped
    assert np.frombuffer(stream.read(), "<u2").tolist() == [1, 2, 3, *range(5000)]
    broken = bytearray(data)
    broken[8] ^= 1
    (tmp_path / "b.tok").write_bytes(broken)
    with (tmp_path / "b.tok").open("rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.ShardReader(f, len(broken)).read(0, 3))


def test_edit_counts(spark, docs, none, texts):
    t = tokenizer(BYTE)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for r, d in zip(sorted(edit_counts.edit_report(docs, BYTE).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])), sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])), strict=True):
        text = d["text"] or ""
        size = len(text)
        assert r["n_tokens"] == n(text)
        for start, length, insert in ((size // 5, 40, ""), (size // 2, 0, " This sentence is new, it's 100% made up. "), (size * 3 // 4, 12, "replacement"), (size + 1000, 0, "\nThe end.")):
            text = text[:start] + insert + text[start + length :]
        assert (r["edited_tokens"], r["edited_chars"]) == (n(text), len(text))
    assert edit_counts.edit_report(none, BYTE).count() == 0
    pre, rng = edit_counts.PreTokens(BYTE), random.Random(1)
    for x in ["", " ", texts[0][1], "word " * 500, "a\n\n  b's 12"]:
        tree = edit_counts.CountTree(x, pre)
        for _ in range(40):
            at, cut, put = rng.randrange(len(tree.text) + 2), rng.choice([0, 1, 3, 60]), "".join(rng.choices([" ", "\n", "a", "'s", "12", "!", "é", " the"], k=rng.choice([0, 1, 5, 200])))
            tree.edit(at, cut, put)
            assert tree.total == n(tree.text) and tree.chars[1] == len(tree.text)


def test_edit_encodes_only_its_surroundings():
    pre = edit_counts.PreTokens(BYTE)
    tree = edit_counts.CountTree("some words here " * 5000, pre)
    tree.edit(40_000, 5, "other")
    assert tree.encoded < 60


def test_imatch(docs, none):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    got = imatch.fingerprint_report(docs).collect()
    assert len(got) == len(rows)
    own = {r["doc_id"]: r for r in got}
    for i, r in enumerate(rows):
        if r["doc_id"] is None or Counter(x["doc_id"] for x in rows)[r["doc_id"]] > 1:
            continue
        text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert own[r["doc_id"]]["n_chars"] == len(text) and own[r["doc_id"]]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len({(texts[r["doc_id"]], r["fingerprint"]) for r in got}) == len({texts[r["doc_id"]] for r in got})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert imatch.fingerprint_report(none).count() == 0
    assert imatch.likeness("0" * 16 + "0001" "0000" "0003", "0" * 15 + "1" + "0001" "0002" "0000") == pytest.approx(1 / 3)


def test_lexicon_is_the_band(docs):
    df = Counter()
    rows = docs.collect()
    for r in rows:
        df.update({w[:-1] if len(w.encode()) > 1 and w[-1] in ".,;:!?" else w for w in toks(r["text"])})
    n = len(rows)
    assert len(imatch.lexicon(docs, least=0.03, most=0.2)) == sum(max(2, 0.03 * n) <= c <= 0.2 * n for c in df.values())


def test_mixing(docs, none):
    rows = docs.collect()
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    size = Counter()
    for r in rows:
        size[r["source"]] += len(toks(r["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        above = {s for s, x in share.items() if x > 3 * size[s]}
        if not above:
            break
        full |= above
    target = {s: 3.0 * size[s] if s in full else share[s] for s in names}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(size[s], round(target[s], 6)) for s in names}
    assert all(0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sum(len(toks(r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_is_near_its_targets(spark):
    rng = random.Random(0)
    rows = [(i, "w " * rng.choice([1, 5, 20, 300]), f"s{i % 5}" if i % 3 else "hot") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in mixing.mix_report(d).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 24))
    close = base[:60] + rng.normal(size=(60, 24)) * 0.18
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, close, base[:5] * 3, base[:4]]))]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan"), *[1.0] * 23]), (n + 4, [None, *[1.0] * 23]), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [float("inf"), *[0.0] * 23]), (n + 8, [1e300] * 24), (n + 9, [2e300] * 24)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = {i: set() for i, _ in rows}
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links[i].add(j)
    label = {i: i for i in links}
    for _ in range(len(rows)):
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
        if new == label:
            break
        label = new
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(links[i]), label[i], label[i] == i) for i in links}
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hmm_counts_and_likelihood(docs, none):
    rows = docs.collect()
    got = hmm.score_documents(docs).collect()
    c = Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for r in rows:
        if not held(r["doc_id"]):
            c.update([*toks(r["text"]), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = [*toks(r["text"]), None]
        want[r["doc_id"], held(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, round(math.fsum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) and all(math.isfinite(r["score"]) for r in got)
    assert hmm.score_documents(none).count() == 0


def test_forward_and_expectations_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    model = hmm.begin_model(rng.integers(0, 50, hmm.CLASSES), 2)
    model.start, model.move = np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]])
    seq, lengths = np.array([5, 9, 5, 7, 9, 5, 5]), np.array([2, 4, 1])
    starts, moves, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2))
    logs, at = [], 0
    for n in lengths:
        s = seq[at : at + n]
        at += n
        paths = {}
        for path in itertools.product(range(2), repeat=int(n)):
            p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.prod([model.emit[k, q] for k, q in zip(s, path, strict=True)])
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / total
            for k, q in zip(s, path, strict=True):
                emitted[k, q] += p / total
    assert hmm.forward(model, seq, lengths) == pytest.approx(logs, rel=1e-9)
    got = hmm.expectations(model, seq, lengths)
    for g, w in zip(got, (starts, moves, emitted), strict=True):
        assert g == pytest.approx(w, rel=1e-4, abs=1e-6)


def test_hmm_model_sums_to_one():
    """Words of a class and its unknown ones share the class; classes share a state."""
    model = hmm.begin_model(np.arange(hmm.CLASSES), 3)
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1)
    n, v = 10, 3  # counts 5, 3, 2 in a class
    assert sum((c + 1) / (n + v + 1) for c in (5, 3, 2, 0)) == pytest.approx(1)
