"""Host rules, near duplicates, toxicity and language against brute force, with odd rows."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from siftmail.llm import lang_spans, queries_host_rules, queries_minmax_dedup, toxic_lexicon
from siftmail.llm.host_rules import judge
from siftmail.llm.minmax_dedup import near_duplicates
from siftmail.llm.shingles import WordHashes, shingle_set

ODD = [None, "", " \t\n", "one", "a b", "A B", "x " * 400, "é ü   nbsp", "l1\nl1\n\nl1 \nl2", "# * $ % & | < >", "w " * 3 + "v " * 3 + "w w w", "a b", "\x0b\x0c\r"]


def duck(sql, rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return c.sql(sql).df()


def as_rows(df):
    return sorted(map(str, df.astype(object).where(df.notna(), None)[sorted(df.columns)].values.tolist()))


def table_of(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("rows", [[], [(i, t, None, random.Random(i).choice([None, "", "h"]), None) for i, t in enumerate(ODD)]])
def test_host_rules_on_odd_rows(spark, tmp_path, rows):
    table_of(spark, rows, tmp_path)
    got = queries_host_rules.op2_host_rules(spark, str(tmp_path)).toPandas()
    assert as_rows(got) == as_rows(duck(queries_host_rules.SQL["op2_host_rules"], rows))


def test_bad_hosts_lose_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [("bad", "x", i) for i in range(400)] + [("bad", good, 999)] + [("fine", good, i) for i in range(400, 900)] + [("small", "x", 901)]
    df = spark.createDataFrame([(i, t, h, 0) for h, t, i in rows], "doc_id long, text string, source string, kept int")
    got = {(r["host"], r["doc_id"]): r for r in judge(df).collect()}
    assert not got["bad", 999]["kept"] and got["fine", 400]["kept"]
    assert 0.4 < got["small", 901]["host_rate"] < 1  # shrunk away from 1


def test_a_bad_host_decides_in_the_query(spark, tmp_path):
    """Ordinary hosts fail some documents and stay; one that fails most goes, good documents included; one with too
    few documents to be sure stays. The same in SQL."""
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(80))
    rows = [(i, "short" if rng.random() < 0.12 else good(), None, f"h{i % 12}", None) for i in range(600)]
    rows += [(600 + i, "short" if i % 4 else good(), None, "bad", None) for i in range(60)] + [(700, "short", None, "tiny", None), (701, good(), None, "tiny", None)]
    table_of(spark, rows, tmp_path)
    got = queries_host_rules.op2_host_rules(spark, str(tmp_path)).toPandas()
    assert as_rows(got) == as_rows(duck(queries_host_rules.SQL["op2_host_rules"], rows))
    by = got.set_index("doc_id")
    hosts = {i: h for i, _, _, h, _ in rows}
    for i, r in by.iterrows():
        assert r.kept == (not r.base_failed and hosts[i] != "bad") and r.host_failing == (hosts[i] == "bad")
    assert (~by.base_failed & ~by.kept).sum() == 15


def near_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in that it was".split()) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    texts = list(ODD)
    for size in (12, 40, 200):
        base = [word() for _ in range(size)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own))
        chain = list(base)
        for _ in range(10):  # neighbours are alike, ends are not
            for _ in range(max(1, size // 30)):
                chain[rng.randrange(size)] = word()
            texts.append(" ".join(chain))
    return [(5 * i + 2, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [[], near_rows()])
def test_near_duplicates_against_sql(spark, tmp_path, rows):
    table_of(spark, rows, tmp_path)
    got = queries_minmax_dedup.op3_minmax_dedup(spark, str(tmp_path)).toPandas()
    assert as_rows(got) == as_rows(duck(queries_minmax_dedup.SQL["op3_minmax_dedup"], rows))


def test_near_duplicates_of_repeated_rows_and_null_ids(spark, docs_of):
    df = docs_of(["a b c d e f g", "a b c d e f g", "other words are here now ok"])
    got = near_duplicates(df.unionByName(df).unionByName(df.selectExpr("cast(null as long) doc_id", *df.columns[1:])), shingle=2).collect()
    assert len(got) == 9
    for r in got:
        assert r["component_id"] == {1: 1, 2: 1, 3: 3, None: None}[r["doc_id"]] and r["kept"] == (r["doc_id"] != 2)


def test_shingles_are_sets_of_windows():
    cache = WordHashes()
    assert len(shingle_set("a b a b a", cache, 2)) == 2 and len(shingle_set("a", cache, 2)) == 1 and len(shingle_set(None, cache, 2)) == 0
    assert (shingle_set("AÉ b", cache, 2) == shingle_set("aÉ\tb", cache, 2)).all() and (shingle_set("aÉ b", cache, 2) != shingle_set("aé b", cache, 2)).all()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "moron", "blockhead", "loser", "losers"]
    lexicon = toxic_lexicon.Lexicon(terms)
    rng = random.Random(1)
    words = set(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "o", "s"])
            words.add("".join(w))
    for w in words:
        reach = [(edit_distance(w, t), i) for i, t in enumerate(terms) if edit_distance(w, t) <= toxic_lexicon.errors_for(t)]
        assert lexicon.match(w) == (min(reach) if reach else None), w


def test_quotation_and_address():
    m = toxic_lexicon.Matcher(toxic_lexicon.Lexicon(["idiot"]))
    plain, cited, direct = (toxic_lexicon.hits(t, m)[0] for t in ("what an idiot that is", 'he said "idiot" in the text', "you are an idoit-like idiott"))
    assert (plain["quoted"], cited["quoted"], direct["addressed"], direct["errors"]) == (False, True, True, 1)
    model = toxic_lexicon.Model(m.lexicon, -3.0, toxic_lexicon.PRIOR)
    a, b = (model.score(np.array([toxic_lexicon.evidence(t, m)]))[0] for t in ("idiot", 'said "idiot"'))
    assert a > b


def test_toxicity_query_against_brute_force(spark, tmp_path):
    """Terms by the Wilson bound, exceptions by edit distance, contexts word by word, the weights by plain gradient
    steps; scores of all documents, labelled or not."""
    import zlib

    rng = random.Random(12)
    clean = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 9))) for _ in range(300)]
    texts, label = [], {}
    for i in range(160):
        w = rng.sample(clean, 25)
        bad = i % 4 == 0
        for term in ("blockhead", "moron") if bad else ():
            if rng.random() < 0.8:
                w[rng.randrange(len(w))] = term if rng.random() < 0.8 else term[:-1] + "x"
        if rng.random() < 0.2:
            w[rng.randrange(len(w))] = "said"
        if rng.random() < 0.1:
            w[rng.randrange(len(w))] = "morons"
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "you"
        texts.append(" ".join(w))
        if i < 140:
            label[i] = int(bad)
    texts += [None, "", 'the "moron" was quoted', "blokhead you"]
    table_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], tmp_path)
    spark.createDataFrame([(i, 1, y) for i, y in label.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from siftmail.llm.queries_toxic_lexicon import op4_toxicity

    got = {r["doc_id"]: r for r in op4_toxicity(spark, str(tmp_path)).collect()}
    learn = [i for i in label if zlib.crc32(str(i).encode()) % 4 != 2]
    n, pos = Counter(), Counter()
    for i in learn:
        for w in set(texts[i].split()):
            n[w] += 1
            pos[w] += label[i]
    base = (sum(label[i] for i in learn) + 0.5) / (len(learn) + 1)

    def low(w, z=3.1):
        p = pos[w] / n[w]
        return (p + z * z / (2 * n[w]) - z * np.sqrt(p * (1 - p) / n[w] + z * z / (4 * n[w] ** 2))) / (1 + z * z / n[w])

    terms = sorted(w for w in n if len(w) >= 4 and pos[w] >= 5 and pos[w] >= 0.6 * n[w] and low(w) > base + 0.25 * (1 - base))
    assert {"blockhead", "moron"} <= set(terms)
    reach = lambda w: min(((edit_distance(w, t), t) for t in terms if edit_distance(w, t) <= (2 if len(t) >= 8 else 1)), default=None) if len(w) >= 3 else None
    fine = {w for w in n if len(w) >= 4 and n[w] > pos[w] and 2 * (n[w] - pos[w]) >= pos[w] and (f := reach(w)) and f[0]}
    assert "morons" in fine

    def evidence(t):
        w = re.findall(r"\w+", (t or "").lower())
        marked = {k for k in range(len(w)) if t and '"' in t}  # the one quotation here is within the window
        counts = np.zeros(4)
        for k, x in enumerate(w):
            f = reach(x)
            if f and not (f[0] and x in fine):
                near = set(w[max(0, k - 5) : k + 6])
                counts += 1, f[0] > 0, bool(near & toxic_lexicon.REPORTING) or k in marked, bool(near & toxic_lexicon.ADDRESS)
        return np.log1p(counts)

    x = np.array([np.append(1, evidence(texts[i])) for i in learn])
    y = np.array([label[i] for i in learn])
    mean, precision = np.array([-3.0, 2.0, -0.5, -1.0, 0.5]), np.array([1e-3, 1, 1, 1, 1])
    w = mean.copy()
    for _ in range(60_000):
        w += 0.02 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - precision * (w - mean))
    for i, t in enumerate(texts):
        want = 1 / (1 + np.exp(-np.append(1, evidence(t)) @ w))
        assert abs(got[i]["score"] - want) < 1e-4 and got[i]["predicted"] == (got[i]["score"] >= 0.3), (i, t)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_without_labels_and_of_odd_texts(spark, docs_of):
    model = toxic_lexicon.fit(spark.createDataFrame([], "text string, toxic int"))
    df = docs_of(ODD)
    got = df.select(toxic_lexicon.toxicity(df["text"], model).alias("s"))
    assert {round(r["s"], 6) for r in got.collect()} == {0.05}


def test_every_exception_is_kept(spark):
    spelled = ["".join(w) for w in itertools.islice(((*"bl", a, *"ckhe", b, "d") for a in "abcdefghijklmnopqrstuvwxyzäöüéèàçñßøåæœабвгдежзиклмнпрстуфхцчшэюя" for b in "bcdefghijklmnopqrstuvwxyzäöüéèàçñßøåæœабвгдежзиклмнпрстуфхцчшэюя"), 4400)]
    bad = [(f"blockhead alone in number{i} text{i}", 1) for i in range(60)]
    fine = [(" ".join(spelled[i::80]), 0) for i in range(80)]
    model = toxic_lexicon.fit(spark.createDataFrame(bad + fine, "text string, toxic int"))
    assert "blockhead" in model.lexicon.terms and set(spelled) - {"blockhead"} <= model.lexicon.exceptions
    assert len(model.lexicon.exceptions) > 4000 and all(model.lexicon.match(w) is None for w in spelled)


def test_every_term_that_passes_is_kept(spark):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(700)})
    bad = [(" ".join(w for w in terms if rng.random() < 0.3), 1) for _ in range(150)]
    fine = [(f"plain{i} words{i} here{i} 123", 0) for i in range(300)]
    model = toxic_lexicon.fit(spark.createDataFrame(bad + fine, "text string, toxic int"))
    assert model.lexicon.terms == terms


def viterbi_brute(score, switch):
    n, k = score.shape
    return max(sum(score[i, p[i]] for i in range(n)) - switch * sum(p[i] != p[i - 1] for i in range(1, n)) for p in itertools.product(range(k), repeat=n))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = [5, 1, 3, 6]
    score = rng.normal(0, 3, (sum(lengths), 3)).astype(np.float32)
    text = np.repeat(np.arange(4), lengths)
    label = lang_spans._viterbi(score, text, 4, 2.0)
    for t in range(4):
        s, p = score[text == t], label[text == t]
        own = sum(s[i, p[i]] for i in range(len(p))) - 2.0 * int((p[1:] != p[:-1]).sum())
        assert abs(own - viterbi_brute(s, 2.0)) < 1e-3


def test_more_languages_than_a_byte_has():
    rng = np.random.default_rng(1)
    score = rng.normal(0, 1, (40, 300)).astype(np.float32)
    want = np.repeat([299, 7, 256, 280], 10)
    score[np.arange(40), want] += 50
    assert lang_spans._viterbi(score, np.repeat([0, 1], 20), 2, 3.0).tolist() == want.tolist()
    model = lang_spans.Model([f"l{i:03}" for i in range(300)], np.full((lang_spans.BUCKETS, 300), -9, np.float32), np.ones((lang_spans.OTHER + 2, 300), bool))
    model.logp[:, 270] = -1
    assert lang_spans._predict(["some words of this text"], model, 8.0)[0] == ["l270"]


def gram_buckets(word):
    """Buckets of the 3- and 4-grams of a word with its ends, by the words of the model."""
    w, mask = f" {word} ", (1 << 64) - 1
    for n in (3, 4):
        for i in range(len(w) - n + 1):
            h = [ord(c) * 0x9E3779B97F4A7C15 & mask for c in w[i : i + n]]
            x = h[0]
            for y in h[1:]:
                x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 + y) & mask
            yield ((x ^ x >> 32) * 0x94D049BB133111EB & mask) >> 48


def test_language_query_against_brute_force(spark, tmp_path):
    """The whole query on a small table: counts, scripts, candidates, best path by trying all, shares of letters."""
    import zlib

    words = {"en": "the that from this", "fr": "les cette très beaux", "ru": "слова этого из"}
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 7))) for lang in (list(words) * 12)]
    texts += ["the that cette très beaux", "слова the этого", "42 !", "", None, "the 7 les"]
    rows = [(i, t, [*words][i % 3] if i < 36 else None, None, None) for i, t in enumerate(texts)]
    table_of(spark, rows, tmp_path)
    from siftmail.llm.queries_lang_spans import op9_language_id

    got = {r["doc_id"]: r for r in op9_language_id(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}
    langs = sorted({lang for i, _, lang, _, _ in rows if lang and not held[i]})
    cyrillic = lambda w: sum("а" <= c <= "я" for c in w) > sum(c.isalpha() for c in w) / 2
    grams, letters = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for i, t, lang, _, _ in rows:
        if lang and not held[i]:
            for w in t.split():
                grams[lang].update(gram_buckets(w))
                letters[lang][cyrillic(w)] += sum(map(str.isalpha, w))
    total = {x: sum(grams[x].values()) + 0.5 * lang_spans.BUCKETS for x in langs}
    for i, t in enumerate(texts):
        spoken = [w for w in (t or "").split() if any(map(str.isalpha, w))]
        if not spoken:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        best = None
        every = (t or "").split()
        for path in itertools.product(langs, repeat=len(every)):
            s = -8.0 * sum(a != b for a, b in zip(path, path[1:]))
            for w, x in zip(every, path):
                if any(map(str.isalpha, w)):
                    s += sum(np.log((grams[x][g] + 0.5) / total[x]) for g in gram_buckets(w)) if letters[x][cyrillic(w)] else -1e6
            if best is None or s > best[0] + 1e-6:
                best = (s, path)
        share = Counter()
        for w, x in zip(every, best[1]):
            share[x] += sum(map(str.isalpha, w))
        top = max(sorted(langs), key=lambda x: share[x])
        assert got[i]["lang_pred"] == top and abs(got[i]["score"] - share[top] / sum(share.values())) < 1e-9, t


def test_languages_and_spans(spark):
    words = {"en": "the quick words of this text are from that house", "fr": "les mots rapides de cette maison sont très beaux", "ru": "быстрые слова этого текста из дома", "de": "die schnellen wörter aus diesem haus"}
    rng = random.Random(1)
    say = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    train = spark.createDataFrame([(i, say(lang, 30), lang) for i, lang in enumerate(list(words) * 20)] + [(999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string")
    model = lang_spans.fit(train)
    assert model.langs == ["de", "en", "fr", "ru"]
    texts = [None, "", "12 34 !", *(say(lang, 20) for lang in words), say("en", 30) + " " + say("de", 12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", lang_spans.language_of(df["text"], model).alias("p")).collect()}
    assert [got[i]["lang"] for i in range(8)] == ["und"] * 3 + list(words) + ["en"]
    assert got[0]["score"] == 0 and 0.5 < got[7]["score"] < 0.9
    runs = [r for r in lang_spans.spans(df, model).collect() if r["doc_id"] == 7]
    assert Counter(r["lang"] for r in runs) == {"en": 1, "de": 1}
    assert texts[7][runs[1]["start"] :][: runs[1]["length"]].split()[0] in words["de"]
    assert lang_spans.fit(train.where("lang = 'xx'")).langs == []


def test_words_of_a_batch_are_those_between_blanks():
    texts = ["a  bé\tc", "", " x ", "İstanbul ok"]
    w = lang_spans.Words(texts)
    assert Counter(w.text) == Counter(i for i, t in enumerate(texts) for _ in re.findall(r"[^ \t]+", t))
