import html
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import corpus_plain as plain
import licence_texts
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import components, decontamination, exact_dedup, html_extract, html_labelled, langid, license_scan, license_sentences, packing, queries, shared, sharding, simhash, substring_dedup, toxicity
from driftline.llm import lexing as lx
from driftline.llm.wordbpe import Tables, WordBpe

R = random.Random(11)
VOCAB = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "A.B", "the", "The"]
LONG = " ".join(R.choice(VOCAB) for _ in range(30_000))
PASSAGES = [[R.choice(VOCAB) for _ in range(n)] for n in (20, 36, 45, 80, 200)]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def corpus(n=120):
    rows = []
    for i in range(n):
        w = [R.choice(VOCAB) for _ in range(R.randint(0, 60))]
        for _ in range(R.randint(0, 2)):
            at = R.randint(0, len(w))
            w[at:at] = R.choice(PASSAGES)
        rows.append((i, R.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(n + k, rows[k % 7][1].replace(" ", "\n")) for k in range(20)]  # copies but for white space
    rows += [(300 + k, rows[30][1] + f" end{k}") for k in range(15)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "x"), (504, "x"), (None, "lost id"), (None, None), (7, rows[3][1]), (7, rows[3][1]), (600, LONG), (601, "a " * 400), (602, "a " * 90 + "b")]
    return rows


ROWS = corpus()


def table(spark, rows=ROWS, extra=True):
    """Rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ("kept", "score", "shard", "slot", "size", "_id", "lang", "n_words", "_fp", "label", "a", "b")
    return df.withColumns({c: F.lit("z") for c in names}) if extra else df


def out(df, *cols):
    return sorted(str(tuple(r)) for r in df.select(*cols).collect())


def strings(rows):
    return sorted(str(tuple(r)) for r in rows)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- 1


def test_shards_are_exact_and_gapless(spark):
    df = spark.range(1000).repartition(7).withColumns({"shard": F.lit("old"), "text": F.lit(None).cast("string")})
    rows = sharding.shard(df, 24, block_rows=9).collect()
    assert sorted(r["id"] for r in rows) == list(range(1000))
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.shard(spark.range(0).repartition(3), 5).count() == 0
    assert sharding.shard(spark.range(2), 5).count() == 2


def test_matrix_rows_add_up():
    sizes, cap = np.array([5, 0, 17, 3, 25, 1]), np.array([10, 10, 11, 20])
    for seed in range(20):
        m = np.array([sharding.matrix_row(sizes, cap, p, seed) for p in range(len(sizes))])
        assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == cap).all() and (m >= 0).all()


def test_matrix_is_hypergeometric():
    sizes, cap = np.array([6, 6]), np.array([6, 6])
    first = Counter(int(sharding.matrix_row(sizes, cap, 0, seed)[0]) for seed in range(4000))
    want = {k: v / 924 for k, v in zip(range(7), (1, 36, 225, 400, 225, 36, 1), strict=True)}
    assert all(abs(first[k] / 4000 - want[k]) < 0.03 for k in want)
    rng = np.random.default_rng(0)
    big = [sharding.draw(rng, 3_000_000_000, 1_000_000_000, 1_000_000) for _ in range(50)]
    assert abs(np.mean(big) - 750_000) < 300 and np.std(big) < 1000


def test_shards_keep_all_columns(spark):
    df = spark.createDataFrame([(i, f"k{i}", i * 2, "x") for i in range(50)] + [(None, None, None, None)] * 3 + [(7, "k7", 14, "x")] * 2, "_block long, _key string, _first int, n string").repartition(4)
    got = sharding.shard(df, 3, block_rows=5)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert strings(r[:4] for r in got.collect()) == strings(df.collect())
    assert strings(got.select("shard", "slot").collect()) == strings((s, k) for s in range(3) for k in range(19 if s == 0 else 18))


def test_shuffle_is_uniform(spark):
    counts = Counter()
    df = spark.range(6).repartition(2)
    for seed in range(40):
        for r in sharding.shard(df, 2, seed=seed, block_rows=2).collect():
            counts[r["id"], r["shard"], r["slot"]] += 1
    assert len(counts) == 36 and max(counts.values()) <= 18  # 40 / 6 each


def test_shard_query(spark, tmp_path):
    rows = [*ROWS, (None, None), (900, "Ünï 日本")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_hypergeometric_shard(spark, str(tmp_path)).collect()
    assert strings((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == strings((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


# ---- 2


@pytest.mark.parametrize("window", [35, 8, 1])
def test_repeats(spark, window):
    got = substring_dedup.removed(table(spark), window=window)
    assert out(got, "doc_id", "n_words", "n_removed", "kept_sha256") == strings(plain.repeats(ROWS, window))


def test_repeats_in_few_words(spark):
    r = random.Random(3)
    rows = []
    for i in range(50):
        w = []
        while len(w) < r.randint(1, 150):
            k = r.random()
            w += [r.choice("ab")] * r.randint(1, 70) if k < 0.4 else ["a", "b"] * r.randint(1, 40) if k < 0.6 else [r.choice("abc") for _ in range(r.randint(1, 50))]
        rows.append((i, " ".join(w)))
    got = substring_dedup.removed(table(spark, rows))
    assert out(got, "doc_id", "n_words", "n_removed", "kept_sha256") == strings(plain.repeats(rows, 35))
    assert substring_dedup.removed(empty(spark)).count() == 0


def test_kept_text(spark):
    p = " ".join(f"q{i}" for i in range(40))
    rows = substring_dedup.removed(table(spark, [(1, f"one {p} two"), (2, p), (3, "three")]), keep_text=True).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "one two", 2: "", 3: "three"}


# ---- 3


LANGS = {"en": "the and of that with tion ing is was for", "de": "der die und ein sch ung lich keit für über", "fr": "le la les des que été être eau ment où"}


def speech(lang, r, n=40):
    return " ".join(r.choice(LANGS[lang].split()) + r.choice(LANGS[lang].split()) for _ in range(n))


def test_language(spark):
    r = random.Random(1)
    train = [(i, speech(k, r), k) for i in range(90) for k in LANGS] + [(999, None, "en"), (998, "text", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.train(langid.sample(df))
    assert model.languages == sorted(LANGS)
    test = [(4 * i + j, speech(k, r, 6), k) for i in range(40) for j, k in enumerate(LANGS)]
    odd = [(1000, None, "und"), (1001, "", "und"), (1002, "12 -- ,.", "und"), (1003, "…", "und")]
    got = {x["doc_id"]: x for x in langid.predictions(table(spark, [x[:2] for x in test + odd]), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i, *_ in odd)
    assert sum(got[i]["lang_pred"] == k for i, _, k in test) >= 110
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.train(langid.sample(df.limit(0))) is None
    assert {x["lang_pred"] for x in langid.predictions(df, None).collect()} == {"und"}


def test_code_lengths_are_those_of_the_trees():
    texts = {"x": ["Abracadabra arbor", "bar"], "y": ["banana bandana"], "z": ["été à la mer \U0001f30a"], "u": ["zz"], "v": ["quiz quiz"]}
    model = langid.train(texts)
    assert model.languages == sorted(texts)
    for j, lang in enumerate(model.languages):
        counts = Counter()
        for text in texts[lang]:
            padded = [0x20] * langid.ORDER + list(text.encode().lower())
            for k in range(langid.ORDER + 1):
                for i in range(langid.ORDER, len(padded)):
                    counts[tuple(padded[i - k : i]), padded[i]] += 1

        def cost(context, s, counts=counts):
            own = {x: n for (c, x), n in counts.items() if c == context}
            shorter = (lambda: cost(context[1:], s)) if context else (lambda: 8)
            if not own:
                return shorter()
            total, kinds = sum(own.values()), len(own)
            return np.log2(total + kinds) - np.log2(own[s]) if s in own else np.log2(total + kinds) - np.log2(kinds) + shorter()

        docs = ["abandon Arbor! été \U0001f30a", "", "x", "quizquiz" * 500]
        raw = [d.encode() for d in docs]
        got = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))[:, j] / langid.UNIT
        for n, r in zip(got, raw, strict=True):
            syms = [0x20] * langid.ORDER + list(r.lower())
            want = sum(cost(tuple(syms[i - langid.ORDER : i]), syms[i]) for i in range(langid.ORDER, len(syms)))
            assert n == pytest.approx(want, abs=0.002 * len(r) + 0.01)


def test_many_languages(spark):
    r = random.Random(2)
    parts = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(r.randint(2, 4))) for _ in range(12)] for k in range(12)}
    say = lambda k, n: " ".join(r.choice(parts[k]) + r.choice(parts[k]) for _ in range(n))
    rows = [(100 * i + j, say(k, 40), k) for i in range(40) for j, k in enumerate(parts)]
    model = langid.train(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert model.languages == sorted(parts) and len(model.tables) == 3
    test = [(100 * i + j, say(k, 5), k) for i in range(20) for j, k in enumerate(parts)] + [(5000, say("l03", 200_000), "l03"), (5000, say("l03", 9), "l03"), (None, say("l04", 9), "l04")]
    got = langid.predictions(table(spark, [x[:2] for x in test]), model).select("doc_id", "lang_pred").collect()
    wrong = Counter((i, k) for i, _, k in test) - Counter(map(tuple, got))
    assert len(got) == len(test) and wrong.total() <= 3
    assert langid.predictions(empty(spark), model).count() == 0


def test_sample_is_bounded(spark):
    rows = [(i, "x" * (50 + i), "en") for i in range(300)] + [(1000 + i, "y" * 5000, "de") for i in range(4)] + [(2000, "", "fr"), (2001, None, "fr")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=20, max_bytes=2000)
    assert set(got) == {"en"} and 5 <= len(got["en"]) <= 20 and sum(map(len, got["en"])) <= 2000


def test_index_finds_what_it_holds():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        found = langid.Index(keys)
        assert (found.find(keys) == np.arange(len(keys))).all()
        other = np.setdiff1d(rng.integers(0, 1 << 32, 1000, dtype=np.uint32), keys)
        assert (found.find(other) == -1).all()


# ---- 4


def test_licences(spark):
    rows = [(1, "Some words.\nLicensed under the Apache License, Version 2.0.\nMore."), (3, "Released under the MIT License."), (4, "word | word |\nThis work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), (6, "a licence to kill"), (7, None), (8, ""), (9, "SPDX-License-Identifier: Zlib"), (10, "In no event shall the author be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."), (11, "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License."), (3, "Released under the MIT License."), (None, "Released under the MIT License."), (12, "word " * 400_000 + ".\nReleased under the MIT License.\n" + "word " * 1000)]
    got = [(r["doc_id"], r["licences"], r["unmatched"]) for r in license_scan.scan(table(spark, rows).withColumn("licences", F.lit(1))).collect()]
    want = {1: "Apache-2.0", 3: "MIT", 4: "GPL-3.0", 5: "CC-BY-NC-4.0", 6: "", 7: "", 8: "", 9: "Zlib", 10: "", 11: "MIT,CC-BY-NC-4.0", None: "MIT", 12: "MIT"}
    assert len(got) == len(rows) and {k: v for k, v, _ in got} == want
    assert {k: u for k, _, u in got if u} == {10: "mit-liability"}
    assert license_scan.scan(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(licence_texts.TEXTS))
def test_published_texts(name):
    for width in (40, 66, 79, 10_000):
        for lead in ("", "# ", " * ", "// ", "    "):
            lines = [line for p in licence_texts.TEXTS[name] for line in [*textwrap.wrap(p, width, break_on_hyphens=False), ""]]
            text = "Some words before.\n\n" + "\n".join(lead + line for line in lines) + "\n\nint main() { return 0; }\n"
            found, left = license_scan.licences(license_scan.identifiers(text))
            assert found == [name], (width, lead, found, left)
            assert set(left) <= {"zlib-warranty"}


def plain_identifiers(sentences):
    """Sentences given one by one, looked up by comparing each with every known one."""
    out = []
    for s in sentences:
        words = license_scan.normalised(s)
        for name, text in license_sentences.SENTENCES + license_sentences.gnu_sentences():
            pattern = "(?: [^ ]+){1,15} ?".join(re.escape(license_scan.normalised(p)) for p in text.split("*"))
            if re.fullmatch(pattern, words):
                out.append(name)
                break
    return out


def test_known_sentences_against_a_plain_matcher():
    r = random.Random(3)
    pool = license_sentences.SENTENCES + license_sentences.gnu_sentences()
    for _ in range(40):
        said = [r.choice([t for _, t in pool]).replace("*", r.choice(["the holder", "Jane Doe and others"])) if r.random() < 0.8 else "Some other permission is granted under a version" for _ in range(6)]
        text = "\n\n".join("\n".join(textwrap.wrap(s, r.randint(30, 90), break_on_hyphens=False)) + r.choice(["", ".", ";"]) for s in said)
        assert [x for x in license_scan.identifiers(text) if not x.startswith("ref ")] == plain_identifiers(said)


def test_every_known_sentence_holds_a_hint():
    for _, text in license_sentences.SENTENCES + license_sentences.gnu_sentences():
        assert any(h in text.lower().replace("-", " ").encode() for h in license_scan.HINTS), text


def test_references():
    for text, want in (
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("This project is dual licensed under the GPLv3 or later and the BSD 3-Clause license.", ["GPL-3.0-or-later", "BSD-3-Clause"]),
        ("Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("We never used anything licensed under the MIT License.", []),
        ("This is not licensed under the MIT License.", []),
        ('"Released under the MIT License" is what the other file says.', []),
        ("If it were released under the MIT License, all would be well.", []),
        ("The tool, which is released under the MIT License, is old.", []),
        ("Licensed under the Moon Licence.", []),
    ):
        assert license_scan.licences(license_scan.identifiers(text))[0] == want, text


@pytest.mark.parametrize("text", [" " * 300_000 + "licence", "\n" * 300_000 + "licence", " \n" * 200_000 + "licence", "Licensed under " + "MIT or " * 50_000 + "MIT.", "This " + "software " * 100_000 + "is licensed under the MIT License", "# " * 200_000 + "licence", "permission https://" * 50_000, "SPDX-License-Identifier: " + "(" * 100_000, "a. " * 200_000 + "licence"])
def test_licence_scans_take_linear_time(text):
    license_scan.identify("licensed under the mit license")
    began = time.process_time()
    license_scan.licences(license_scan.identifiers(text))
    assert time.process_time() - began < 6


def test_ranges_merge():
    r = random.Random(1)
    rows = [[(a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 9)))] for _ in range(50)]
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array([[{"lo": a, "hi": b} for a, b in x] for x in rows], kind)], names=["_k", "_k2", "ranges"])
    (out,) = substring_dedup._merge_ranges([batch])
    for got, own in zip(out.column(2).to_pylist(), rows, strict=True):
        covered = {k for a, b in own for k in range(a, b)}
        assert {k for x in got for k in range(x["lo"], x["hi"])} == covered
        assert all(x["hi"] < y["lo"] for x, y in zip(got, got[1:], strict=False))


def test_spdx_expressions():
    for text, want in (("MIT */ Copyright 2020 Jane Doe", "MIT"), ("apache-2.0", "Apache-2.0"), ("(MIT OR apache-2.0) and GPL-2.0-only WITH Classpath-exception-2.0 -->", "(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"), ("MIT OR", "MIT"), ("(MIT", ""), ("", ""), ("OR MIT", ""), ("LicenseRef-Own.", "LicenseRef-Own")):
        assert license_scan.spdx(text) == want
    assert license_scan.identifiers("# SPDX-License-Identifier: MIT\n# more words\nhere") == ["spdx MIT"]


def test_rules_follow_order():
    assert license_scan.licences(["mit-notice", "mit-grant"]) == ([], ["mit-notice", "mit-grant"])
    assert license_scan.licences(["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]) == (["BSD-3-Clause"], [])


# ---- 5


def test_fingerprints_and_groups(spark):
    got = simhash.grouped(table(spark), group_rows=4)
    assert out(got, "doc_id", "fingerprint", "component_id") == strings(plain.simhash_groups(ROWS))
    assert simhash.grouped(empty(spark)).count() == 0


def test_hot_groups_are_joined_by_blocks(spark):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    codes = np.unique(center[rng.integers(0, 3, 400)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 6)).astype(np.uint64), axis=1))
    parent = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (int(codes[i]) ^ int(codes[j])).bit_count() <= 4:
                a, b = plain.find(parent, i), plain.find(parent, j)
                parent[max(a, b)] = min(a, b)
    want = Counter(plain.find(parent, i) for i in range(len(codes)))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "_fp long")
    got = components.components(simhash.links(df, len(codes), group_most=20)).groupBy("b").count().collect()
    assert sorted(r["count"] + 1 for r in got) == sorted(n for n in want.values() if n > 1)


@pytest.mark.parametrize("n", [2, 50, 900])
def test_groups_of_codes(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, max(1, n // 3), dtype=np.uint64)
    codes = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        codes ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    codes = np.unique(codes)
    group = rng.integers(0, 3, len(codes))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(codes)]])
    parent = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if group[i] == group[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 4:
                a, b = plain.find(parent, i), plain.find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert simhash.link_groups(codes, bounds).tolist() == [plain.find(parent, i) for i in range(len(codes))]


def test_masks_hold_every_pair_within_reach():
    rng = np.random.default_rng(0)
    for n in (10, 10**8, 10**10, 10**12):
        family = simhash.masks(n)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(diff & m == 0 for m in family)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_near_copies(spark):
    r = random.Random(5)
    base = [[f"v{r.randint(0, 5000)}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        w = list(w)
        w[r.randint(0, 199)] = "changed"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, " ".join(w[:100] + [f"u{r.randint(0, 5000)}" for _ in range(100)])))
    rows += [(400, None), (401, ""), (None, " ".join(base[0]) + " tail"), (402, "a b"), (403, "a b c")]
    kept = [x["doc_id"] for x in simhash.deduplicated(table(spark, rows)).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [*range(30), *range(200, 230), 400, 402, 403]
    assert simhash.deduplicated(empty(spark)).count() == 0


def star(copies, words=400, edits=7, seed=3):
    """A base and edited copies that are similar to it and not to each other."""
    r = random.Random(seed)
    base = [f"v{r.randint(0, 10**6)}" for _ in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(copies):
        w = list(base)
        for k, at in enumerate(sorted(r.sample(range(words // 6), edits))):
            w[6 * at] = f"x{i}-{k}"
        rows.append((i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("blocks", [2048, 90])
def test_near_copies_of_a_base_only(spark, blocks):
    rows = star(300)
    alike = [plain.jaccard(rows[0][1], t) for _, t in rows[1:]]
    apart = [plain.jaccard(rows[i][1], rows[i + 1][1]) for i in range(1, 300)]
    assert min(alike) >= 0.8 and sorted(apart)[150] < 0.75
    kept = simhash.near_groups(table(spark, rows), block_docs=blocks).where("kept").collect()
    assert [x["_key_id"] for x in kept] == [0]


def test_short_near_copies(spark):
    r = random.Random(4)
    rows, pairs = [], 0
    for n in (9, 13, 17, 20, 25, 31, 45, 63):
        for _ in range(20):
            w = [f"v{r.randint(0, 10**6)}" for _ in range(n)]
            more = [f"y{r.randint(0, 10**6)}" for _ in range((n - 4) // 4)]  # similarity 0.8 or little more
            rows += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(w + more))]
            assert plain.jaccard(rows[-2][1], rows[-1][1]) >= 0.8
            pairs += 1
    kept = [x["doc_id"] for x in simhash.deduplicated(table(spark, rows)).collect()]
    assert sorted(kept) == [2 * i for i in range(pairs)]


@pytest.mark.parametrize("frequent", [3, 1000])
def test_short_copies_around_a_common_line(spark, frequent):
    r = random.Random(9)
    line = [f"common{k}" for k in range(12)]
    rows = []
    for i in range(120):
        w = [f"v{r.randint(0, 10**6)}" for _ in range(r.randint(0, 40))] + line
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, f"z{i}"]))]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if plain.jaccard(rows[a][1], rows[b][1]) >= 0.8:
                x, y = plain.find(parent, a), plain.find(parent, b)
                parent[max(x, y)] = min(x, y)
    kept = simhash.near_groups(table(spark, rows), frequent=frequent).where("kept").collect()
    assert {x["_key_id"] for x in kept} == {plain.find(parent, i) for i in range(len(rows))}


def test_frequent_shingles(spark):
    rows = [(i, f"a{i} b{i} one two three four five" if i < 9 else f"a{i} one two three four six") for i in range(15)]
    texts = table(spark, rows).select(F.col("text").alias("_t"))
    assert len(simhash.frequent_shingles(texts, 5, 0.8, 9)) == 1 and len(simhash.frequent_shingles(texts, 5, 0.8, 10)) == 0
    assert len(simhash.frequent_shingles(texts, 5, 0.8, 1, most=3)) <= 3


@pytest.mark.parametrize("n", [60, 111, 113, 225, 700])
def test_samples_of_border_pairs_meet(n):
    rng = np.random.default_rng(n)
    met = 0
    for _ in range(200):
        common = int(np.ceil(n * 8 / 9))
        both = rng.integers(0, 1 << 63, common, dtype=np.uint64) * 2
        a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, n - common, dtype=np.uint64) * 2])) for _ in range(2))
        assert common / (2 * n - common) >= 0.8
        doc, fp = simhash.chunk_samples(np.repeat([0, 1], n), np.concatenate([a, b]), 2)
        met += (np.bitwise_count(fp[doc == 0][:, None] ^ fp[doc == 1][None]) <= simhash.SAMPLE_BITS).any()
    assert met >= 198


def test_families_of_near_and_less_near_copies(spark):
    r = random.Random(12)
    base = [f"v{r.randint(0, 10**6)}" for _ in range(500)]
    rows = []
    for i in range(120):  # members are about 0.75 to each other, the two of a pair 0.85
        w = list(base)
        for at in r.sample(range(60), 7):
            w[8 * at] = f"x{i}-{at}"
        rows.append((2 * i, " ".join(w)))
        v = list(w)
        for at in r.sample(range(60), 6):
            v[8 * at + 4] = f"y{i}-{at}"
        rows.append((2 * i + 1, " ".join(v)))
    parent = list(range(len(rows)))
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both):
                x, y = plain.find(parent, a), plain.find(parent, b)
                parent[max(x, y)] = min(x, y)
    want = {plain.find(parent, i) for i in range(len(rows))}
    kept = simhash.near_groups(table(spark, rows)).where("kept").collect()
    assert {x["_key_id"] for x in kept} == want and len(want) > 1


def test_similar_pairs_join_what_all_pairs_do():
    r = random.Random(8)
    sets = []
    for _ in range(12):
        base = r.sample(range(500), r.randint(3, 40))
        for _ in range(12):
            sets.append(sorted({*r.sample(base, max(1, len(base) - r.randint(0, 4))), *r.sample(range(500), r.randint(0, 2))}))
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.array([x for s in sets for x in s], np.uint64)
    for side in (None, np.arange(len(sets)) % 2):
        want, got = list(range(len(sets))), list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a]), set(sets[b])
                if (side is None or side[a] != side[b]) and len(x & y) >= 0.8 * len(x | y):
                    p, q = plain.find(want, a), plain.find(want, b)
                    want[max(p, q)] = min(p, q)
        for a, b in zip(*simhash.link_similar(doc, h, np.arange(len(sets)), side), strict=True):
            p, q = plain.find(got, a), plain.find(got, b)
            got[max(p, q)] = min(p, q)
        assert [plain.find(got, i) for i in range(len(sets))] == [plain.find(want, i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = plain.find(parent, a), plain.find(parent, b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, plain.find(parent, x)) for x in parent if plain.find(parent, x) != x)
    assert sorted(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 6


COLS6 = ("doc_id", "keep_id", "group_size", "text_sha256")


def test_exact_copies(spark):
    got = exact_dedup.duplicates(table(spark), bucket_rows=10, chain_rows=3)
    want = plain.exact(ROWS)
    assert out(got, *COLS6) == strings([(a, b, c, e) for a, b, c, _, e in want])
    assert got.where("kept").count() == sum(r[3] for r in want)
    assert exact_dedup.duplicates(empty(spark)).count() == 0


def test_colliding_hashes(spark):
    got = exact_dedup.duplicates(table(spark), key=lambda t: F.length(t).cast("long") % 3, bucket_rows=10, chain_rows=5)
    assert out(got, *COLS6) == strings([(a, b, c, e) for a, b, c, _, e in plain.exact(ROWS)])
    assert got.where("kept").count() == len({r[4] for r in plain.exact(ROWS)})


def test_rows_that_stay(spark):
    kept = exact_dedup.deduplicated(table(spark))
    assert kept.columns == table(spark).columns
    want = [(i, t) for (i, t), r in zip(ROWS, plain.exact(ROWS), strict=True) if r[3]]
    assert len(want) == kept.count()
    assert {(r["doc_id"], " ".join((r["text"] or "").split())) for r in kept.collect()} == {(i, " ".join((t or "").split())) for i, t in want}


def test_directory_keeps_range_order(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("_h")).union(spark.range(3000).select(F.lit(77).cast("long").alias("_h")))
    leaves, chains = exact_dedup.directory(df, 200)
    assert chains == [77] and sum(n for *_, n in leaves) == 5000 and max(n for *_, n in leaves) <= 200
    depth, slots = exact_dedup.owners(leaves, 200)
    assert len(slots) == 1 << depth and [o for _, o in slots] == sorted(o for _, o in slots)


# ---- 7


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies <button>ok</button></div><article><h1>A &amp; B</h1><p>First   part of the text,
with a <b>bold</b> word and <a href=x>a link</a> in it.<br>And a line.</p><div class="ad">Buy now</div><p>Last.</p></article>
<section class="comments"><p>I liked this page very much indeed</p></section><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    want = "A & B\n\nFirst part of the text, with a bold word and a link in it. And a line.\n\nLast."
    deep = "<div>" * 2000 + "some deep words here"
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain words < only"), (5, None, deep), (6, "u", "<nav>menu words</nav>"), (1, "u", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.texts(df).collect()]
    assert sorted(got, key=str) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain words < only", 18), (5, "some deep words here", 20), (6, "", 0)], key=str)


def test_pages_without_elements_for_articles():
    page = "<div><a href=/>start</a> <a href=/l>list</a></div><div id=main><div>" + "The first block has a good many words in it. " * 3 + "</div><div>" + "The second block has as many words as the first. " * 3 + "</div></div><div class=sidebar><a href=/a>one</a><p>not the text</p></div><form><label>Name</label></form>"
    assert [b[:9] for b in html_extract.extract(page)] == ["The first", "The secon"]


def page_words(parts):
    return Counter(re.sub(r"<[^>]*>", " ", " ".join(part for part, content in parts if content)).split())


def test_extraction_of_pages_not_learned_from():
    right = 0
    for parts in html_labelled.pages(200, seed=99):
        right += page_words(parts) == Counter(" ".join(html_extract.extract("".join(part for part, _ in parts))).split())
    assert right >= 180


def test_article_text_of_given_pages():
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    for page in pages.html:
        if page is None or (m := re.search(r"<article>(.*)</article>", page, re.S)) is None:
            continue
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", m[1]))
        assert html_extract.extract(page) == [x for x in blocks if x]


def test_names_that_only_look_like_furniture():
    for name, there in (("share-price", True), ("notice-board", True), ("story", True), ("sidebar", False), ("cookie-banner", False), ("comments", False), ("ad", False)):
        page = f"<article><p>One two three four five six seven.</p><div class='{name}'><p>Some inner words stand here.</p></div><p>More words of the text itself.</p></article>"
        assert ("inner" in " ".join(html_extract.extract(page))) == there, name


@pytest.mark.parametrize("page", ["<b>x" * 200_000, "<div>x" * 200_000, "<p>x" * 200_000, "<li>x" * 200_000, "<td><b></i>" * 100_000, "<a href='" * 100_000, "<a " * 200_000, "<!--" * 200_000, "</b>" * 200_000, "<" * 500_000])
def test_time_grows_with_length(page):
    html_extract.weights()
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 4


def test_open_features_are_those_of_the_open_elements():
    r = random.Random(6)
    tags = ["div", "p", "li", "ul", "b", "td", "table", "span", "article", "header"]
    for _ in range(200):
        page = "".join(r.choice([f"<{r.choice(tags)} class=a{r.choice('xyz')}>", f"</{r.choice(tags)}>", "word "]) for _ in range(40))
        held = []
        for _, _, features, same in html_extract.events(page):
            assert same <= len(held) and held[:same] == features[:same]
            held = list(features)


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>some words</p>", "kept", "u")], "page_id long, html string, _html string, Text string")
    got = html_extract.texts(df)
    assert got.columns == ["page_id", "_html", "text", "n_chars"] and got.first()[1:] == ("kept", "some words", 10)
    assert html_extract.texts(df.limit(0)).count() == 0


def test_best_region_is_the_greatest_sum():
    r = random.Random(0)
    for _ in range(300):
        s = [r.randint(-5, 5) for _ in range(r.randint(1, 12))]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))


# ---- 8


ITEMS = [(1, " ".join(PASSAGES[1])), (20, "w1 W2"), (3, None), (4, ""), (5, " ".join(PASSAGES[3][:12])), (5, "x"), (None, "w5"), (6, "日本")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("key", F.lit(1))
    got = decontamination.hits(table(spark), items, max_grams=most)
    assert out(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == strings(plain.hits(ROWS, ITEMS))
    assert decontamination.hits(empty(spark), items, max_grams=most).count() == 0
    none = decontamination.hits(table(spark), items.limit(0), max_grams=most)
    assert none.where("contaminated").count() == 0 and none.count() == len(ROWS)


def test_rows_and_spans_that_go(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontamination.cleaned(table(spark), items)
    want = [i for (i, _), r in zip(ROWS, plain.hits(ROWS, ITEMS), strict=True) if not r[5]]
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(map(str, want))
    cut = decontamination.removed_spans(table(spark, [(1, "keep, w1 W2! this"), (2, None)]), items)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "keep,  ! this", 2: None}


def test_rows_and_spans_that_go_by_join(spark):
    docs = table(spark).union(table(spark, [(1, "keep, w1 W2! this"), (2, None), (2, None)]))
    items = spark.createDataFrame([(1, "w1 w2"), (2, None), (3, ROWS[0][1]), (4, ROWS[1][1])], "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    for most in (0.0, 0.6):
        clean = decontamination.cleaned(docs, items, most_hit=most, max_grams=0)
        assert clean.columns == docs.columns and rows(clean) == rows(decontamination.cleaned(docs, items, most_hit=most))
    assert rows(decontamination.cleaned(docs, items)) != rows(docs)
    assert rows(decontamination.removed_spans(docs, items, max_grams=0)) == rows(decontamination.removed_spans(docs, items)) != rows(docs)


# ---- 9


ODD = ["it's don't I'LL we've", "ABC123 x9y", "<|endoftext|> a<|endoftext|>b", "Straße ÀÉÎ ÿ İx", "日本語 テスト", "áb é", "###$$$ &&!! …—", "\x1cfoo\x1dbar", "a\x85b c", "Σας ΟΔΟΣ", "x" * 500, "🙂🙂 ok", "a×b ÷ 3×4", "œuvre Œuf", "rock'n'roll 'D", "<|ENDOFTEXT|>", "éa", "12 345", "À,Ù.", None, ""]


def test_ids_are_the_librarys():
    t, own = Tokenizer.from_file(TOKENIZER), WordBpe(Tables(TOKENIZER))
    assert own.fast
    texts = [x or "" for x in ODD] + [t or "" for _, t in ROWS]
    for _ in range(2):
        for i, j, data, offs in lx.chunks(pa.array(texts, pa.large_string()), 2000):
            ids, bounds = own.encode(data, offs)
            for d in range(j - i):
                assert ids[bounds[d] : bounds[d + 1]].tolist() == t.encode(texts[i + d], add_special_tokens=False).ids


def test_packing(spark):
    rows = ROWS + [(700 + k, t) for k, t in enumerate(ODD)]
    got = packing.packed(table(spark, rows), TOKENIZER).collect()
    want = plain.pieces(Tokenizer.from_file(TOKENIZER), rows)
    assert strings([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]) == strings(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // packing.CAPACITY) + 1
    assert packing.packed(empty(spark), TOKENIZER).count() == 0


def best_fit(histogram, capacity):
    """Sequences that best fit decreasing needs."""
    room, n = [0] * (capacity + 1), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = next((r for r in range(length, capacity + 1) if room[r]), None)
            if at is None:
                n, at = n + 1, capacity
            else:
                room[at] -= 1
            room[at - length] += 1
    return n


def test_plans():
    r = random.Random(4)
    for case in range(25):
        histogram = {r.randint(1, 100): r.randint(1, 40) for _ in range(r.randint(1, 30))}
        rows, n = packing.plan(histogram, 100, 30)
        used, fill = Counter(), Counter()
        spans = {}
        for length, first, count, seq, off in rows:
            used[length] += count
            spans.setdefault(length, []).append((first, count))
            for k in range(count):
                fill[seq + k] += length
        assert used == Counter(histogram) and len(fill) == n and max(fill.values()) <= 100
        for own in spans.values():
            at = 0
            for first, count in sorted(own):
                assert first == at
                at += count
        assert n <= best_fit(histogram, 100), case
    assert packing.plan({}, 100) == ([], 0)
    assert packing.plan({100: 5}, 100) == ([(100, 0, 5, 0, 0)], 5)


def test_sequences_come_from_the_program():
    rng = np.random.default_rng(0)
    cases = [(np.clip(rng.lognormal(5.5, 0.9, 20_000).astype(int), 1, 2047), 0.001), (rng.integers(600, 1401, 3000), 0.01), (rng.integers(300, 701, 4000), 0.002), (rng.integers(400, 1001, 300), 0.02)]
    for drawn, gap in cases:
        histogram = Counter(drawn.tolist())
        sizes = np.array(sorted(histogram))
        won, bound = packing.solve(sizes, np.array([histogram[int(k)] for k in sizes]), 2048)
        n = won.sequences
        assert sum(times for _, times in won.uses) >= 0.9 * n
        assert bound <= n <= best_fit(histogram, 2048) and n <= bound * (1 + gap) + 1


def test_prices_of_rooms():
    sizes, prices = np.array([3, 5, 8]), np.array([1.0, 2.0, 3.5])
    best = packing.worths(prices, sizes, 20)
    for room in range(21):
        want = max(a + 2 * b + 3.5 * c for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 8 * c <= room)
        assert best[room] == pytest.approx(want)


def test_many_pieces_of_one_length(spark):
    held = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.lit(300)).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack(held, block_rows=7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert sorted(r["ids_crc32"] for r in rows) == list(range(3000)) and len(by) == 667  # 500 of two each, 167 of six short ones


# ---- 10


def toxic_rows(r, n):
    bad = ["stupid", "idiot", "moron"]
    rows = []
    for i in range(n):
        w = [r.choice(["tion", "the", "ing", "and", "of", "er"]) + r.choice(["an", "ou", "re", "st", "en"]) for _ in range(r.randint(20, 80))]
        y = int(r.random() < 0.3)
        for _ in range(3 if y else 0):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity(spark):
    r = random.Random(8)
    rows = toxic_rows(r, 600)
    docs = spark.createDataFrame([x[:2] for x in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9000, 1), (None, 1), (4, rows[4][2])], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    test = toxic_rows(r, 200)
    odd = [(500, "a stupidd person and an idioot said this to the others who were then very sad about it", 1), (501, None, 0), (502, "", 0), (503, "?!", 0)]
    df = table(spark, [x[:2] for x in test + odd]).drop("score")
    got = {x["doc_id"]: x["score"] for x in toxicity.scores(df, model).collect()}
    wrong = [i for i, _, y in test if (got[i] >= 0.3) != bool(y)]
    assert len(wrong) <= 10
    assert got[500] > 0.3 and got[501] == got[502] == got[503] < got[500]
    kept = toxicity.accepted(table(spark, [x[:2] for x in test + odd]), model)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    assert toxicity.scores(empty(spark), model).count() == 0


def plain_score(model, text):
    margin, bias = model
    words = plain.ALNUM.findall(plain.lower(text or ""))
    total = 0.0
    for w in words:
        b = f"<{w}>".encode()
        grams = [b[i : i + n] for n in toxicity.SIZES for i in range(len(b) - n + 1)]
        slots = [((int.from_bytes(g, "little") + len(g)) * int(lx.M1) % (1 << 64)) >> (64 - toxicity.BITS) for g in grams]
        total += sum(float(margin[s]) for s in slots) / max(1, len(slots))
    return 1 / (1 + np.exp(-np.clip(total / (toxicity.NEUTRAL + len(words)) + bias, -40, 40)))


def test_scores_are_those_of_the_bags(spark):
    rng = np.random.default_rng(5)
    model = (rng.normal(0, 8, 1 << toxicity.BITS).astype(np.float32), -0.4)
    rows = [*ROWS[:60], (700, "x" * 3000), (701, "Stupid, STUPID stupid!"), (701, "Stupid, STUPID stupid!"), (702, "é ñ ü 日本"), (600, LONG), (None, None), (None, "w1 w2")]
    got = [(r["doc_id"], round(r["score"], 4)) for r in toxicity.scores(table(spark, rows).drop("score"), model).collect()]
    assert strings(got) == strings((i, round(float(plain_score(model, t)), 4)) for i, t in rows)


def test_sampled_labels(spark):
    docs = spark.createDataFrame([(i, "t" * (10 * i)) for i in range(40)] + [(3, "other"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (50, 1), (None, 0), (60, 0), (4, None)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, max_each=15, max_bytes=1500)
    for k in (0, 1):
        own = [len(t) for t, v in zip(texts, y, strict=True) if v == k]
        assert 0 < len(own) <= 16 and sum(own) <= 1500
    everything, y = toxicity.sample(docs, labels)
    assert len(everything) == 41 and dict(zip(everything, y.tolist(), strict=True))["t" * 20] == 1


def test_toxicity_without_labels(spark):
    docs = table(spark)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.scores(docs, none).collect()} == {0.5}
    assert toxicity.accepted(docs, none).count() == docs.count()
    one = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.scores(docs, one).where("score > 0.01").count() == 0


# ---- shared


def test_rows_stay_with_clashing_columns(spark):
    docs = table(spark).withColumns({"_key_id": F.lit("a"), "_KEY_TEXT": F.lit("b"), "_key_id_r": F.lit("c"), "_any": F.lit("d"), "_n": F.lit("e")})
    for kept in (exact_dedup.deduplicated(docs), simhash.deduplicated(docs)):
        assert kept.columns == docs.columns and {tuple(r) for r in kept.select("_key_id", "_KEY_TEXT", "_key_id_r", "_any", "_n").collect()} == {tuple("abcde")}


def test_batches_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    df = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    got = shared.text_batches(df).mapInArrow(sizes, "n long, b long").collect()
    assert sum(r["n"] for r in got) == 60 and max(r["b"] for r in got) <= shared.TEXT_BYTES + (2 << 20)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_matching_rows(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = spark.range(200).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    counted = shared.cut(rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3"))
    got = shared.matching(rows, counted, ["k"])
    assert strings(got.collect()) == strings(rows.where("k <> 3").collect())
    got = shared.matching(rows, counted.withColumn("c", F.col("k") * 2), ["k"], bring=("c",))
    assert strings(got.select("k", "id", "c").collect()) == strings(rows.where("k <> 3").withColumn("c", F.col("k") * 2).collect())


# ---- words


def test_words_and_windows():
    texts = [t or "" for _, t in ROWS[:150]]
    for _, j, data, offs in lx.chunks(pa.array(texts, pa.string()), 3000):
        starts, ends, bounds = lx.words(data, offs, lx.NOT_SPACE)
        raw = data.tobytes()
        for d in range(len(offs) - 1):
            own = [raw[starts[k] : ends[k]] for k in range(bounds[d], bounds[d + 1])]
            assert own == raw[offs[d] : offs[d + 1]].split()
        h = lx.word_hashes(data, starts, ends)
        of = {}
        for k in range(len(starts)):
            assert of.setdefault(raw[starts[k] : ends[k]], h[k]) == h[k]
        assert len(set(of.values())) == len(of)
    long = ("y" * 1000 + " ") * 3
    starts, ends, _ = lx.words(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]), lx.NOT_SPACE)
    assert len(set(lx.word_hashes(np.frombuffer(long.encode(), np.uint8), starts, ends).tolist())) == 1


def test_null_and_sliced_columns():
    col = pa.array(["a b", None, "", "c"], pa.string()).slice(1)
    parts = [(data.tobytes(), offs.tolist()) for _, _, data, offs in lx.chunks(col)]
    assert parts == [(b"c", [0, 0, 0, 1])]
    assert list(lx.chunks(pa.array([], pa.string()))) == []

