"""Operators against brute force, round trips and held-out labels; defined results of odd input."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernwood.llm import bpe, importance, neighbours, ngram_join, packing, pii, repetition, templates, toxicity, urls, words
from fernwood.llm.components import components

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c a b c"), (6, "x" * 5000), (7, "wörd " * 3000), (8, "ß😀 <|endoftext|> né"), (9, "a b c a b c"), (None, "no key"), (9, "a b c a b c")]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts beside columns that clash with the operators' own."""
    names = ("kept", "score", "spans", "id", "host", "n_words", "key", "class")
    return spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- n-gram join -------------------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = {}
    for key, text in rows:
        w = split(lower(text))
        sets[key] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    top = {k: k for k in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, docs, monkeypatch, n, percent):
    random.seed(n)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(ngram_join, "SLICE", 3_000)  # so that buckets span slices
    base = [w for _, t in rows[:3] for w in split(t)][:400]
    for i in range(120):  # copies at every distance around the threshold, short and long
        w = base[: random.choice([4, 9, 10, 12, 20, 60, 200, 400])]
        for _ in range(random.randint(0, max(1, len(w) // 25))):
            w[random.randrange(len(w))] = random.choice(["new", "word", "The"])
        rows.append((10_000 + i, " ".join(w)))
    got = ngram_join.join(spark.createDataFrame(rows, DOCS), n=n, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, n, percent)


def test_gathered_signers():
    rng = np.random.default_rng(5)
    sigs, ids = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(-20, 20, 300)
    want = defaultdict(set)
    for g, i in zip(sigs.tolist(), ids.tolist(), strict=True):
        want[g].add(i)
    sig, hub, group, of, inside = ngram_join.gathered(sigs, ids)
    members = defaultdict(set)
    for g, i in zip(of.tolist(), inside.tolist(), strict=True):
        assert i not in members[g]
        members[g].add(i)
    assert {g: (h, members[n] if n else {h}) for g, h, n in zip(sig.tolist(), hub.tolist(), group.tolist(), strict=True)} == {g: (min(v), v) for g, v in want.items()}
    assert len(set(map(frozenset, members.values()))) == len(members)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        low = ngram_join.bands(percent, 1 << 20)
        for size in (4, 5, 9, 10, 11, 17, 30, 100, 390, 410, 1500):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                d = ngram_join.most_different(size, percent)
                drop = rng.integers(0, d + 1)
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, d - drop).astype(np.uint64))))
                if ngram_join.linked(a, b, percent) and drop + d - drop:
                    assert set(ngram_join.signatures(a, percent, low)) & set(ngram_join.signatures(b, percent, low)) or not ngram_join.most_different(min(len(a), len(b)), percent)


def test_large_sets_with_many_empty_thirds_share_a_signature():
    """Elements of one third of each part, and a difference in every part: all that agrees under the first split is empty."""
    rng = np.random.default_rng(2)
    low = ngram_join.bands(80, 1 << 20)
    band = int(np.searchsorted(low, 400, side="right")) - 1
    parts, spare = ngram_join.plan_of(low[band + 1] - 1, 80)
    pool = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    cell = ((words.mix(pool ^ ngram_join.SEEDS[0]) >> np.uint64(32)) * np.uint64(3 * parts) >> np.uint64(32)).astype(np.int64)
    pool, part = pool[cell % 3 == 0], (cell // 3)[cell % 3 == 0]
    first = np.unique(part, return_index=True)[1]
    gone = np.concatenate((first, np.setdiff1d(np.arange(len(pool)), first)[: 100 - len(first)]))
    kept = np.setdiff1d(np.arange(len(pool)), gone)[:400]
    a, b = np.sort(pool[np.concatenate((gone, kept))]), np.sort(pool[kept])
    assert spare and len(first) == parts and ngram_join.linked(a, b, 80)
    lone = [set(np.concatenate([f[~e] for f, e in ngram_join._cells(x, band, parts, np.uint64(0), 0)]).tolist()) for x in (a, b)]
    assert not lone[0] & lone[1]
    assert set(ngram_join.signatures(a, 80, low).tolist()) & set(ngram_join.signatures(b, 80, low).tolist())


@pytest.mark.parametrize("passage", [12, 40])
def test_join_of_wide_buckets(spark, monkeypatch, passage):
    """Many unlike texts with one passage: they share signatures, meet by a second one, and lose no link."""
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    monkeypatch.setattr(ngram_join, "SLICE", 2_000)
    rng = random.Random(passage)
    common = " ".join(f"common{k}" for k in range(passage))
    rows = []
    for i in range(150):
        own = [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 12))]
        rows.append((i, f"{common} {' '.join(own)}"))
    want = brute_components(rows, 2, 80)
    got = ngram_join.join(spark.createDataFrame(rows, DOCS), n=2, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_of_repeated_keys(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (7, "something else"), (7, text), (4, text + " more"), (None, text), (None, "alone"), (9, "something else")]
    got = Counter((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, DOCS), n=3, percent=90).collect())
    assert got == Counter({(7, 38, 7, 4): 2, (4, 39, 4, 4): 1, (None, 38, 7, 4): 1, (7, 1, 7, 7): 1, (9, 1, 7, 7): 1, (None, 1, None, None): 1})


def test_join_of_odd_rows(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(odd, n=3, percent=90).collect()}
    assert got[1] == got[1][:1] + (1,) and got[1][0] == got[2][0] == got[3][0] == 0 and got[4] == (1, 4)
    assert got[5] == (3, 5) and got[9] == (3, 5) and None in got
    assert ngram_join.join(odd.filter("false")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


# --- tokens ------------------------------------------------------------------------------------------------------

HARD = ["", "a<|endoftext|>b c", "<|endoftext|>" * 3, "hi   there\n\n x\x1cy z　 ́é 12½ ²", "a" * 4000, "ab" * 2500 + "c", " " * 3000 + "x", "😀👍🏽 日本語テキスト русский", "don't I'LL we'll ’s", "﻿​ x"]


def test_encoders_equal_the_library(docs):
    random.seed(2)
    texts = HARD + ["".join(random.choice("abcdeinst thers \n'é½😀日12.,") for _ in range(random.randint(1, 60))) for _ in range(500)] + [r.text for r in docs.limit(60).collect()]
    want = [e.ids for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]
    mine, fast = bpe.codec(VOCAB), bpe.merge_encoder(VOCAB)
    for text, ids in zip(texts, want, strict=True):
        packed = np.frombuffer(mine.encode(text), "<u4")
        assert packed.tolist() == ids
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == ids
        assert mine.decode(packed) == text.encode()


def test_digests_equal_the_library(spark, docs, odd):
    lib = Tokenizer.from_file(VOCAB)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for r in both.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(both, VOCAB).collect()) == want
    got = bpe.tokenize(odd, VOCAB).filter("doc_id = 8").first()
    assert bytes(got.decoded).decode() == ODD[7][1]
    assert bpe.tokenize(odd.filter("false"), VOCAB).count() == 0


def packed_well(rows, texts):
    lib = Tokenizer.from_file(VOCAB)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for key, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc.pop(key), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / total


def test_packing(spark, docs, odd):
    assert packed_well(packing.pack(docs, VOCAB).collect(), {r.doc_id: r.text for r in docs.collect()}) < 0.01
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert packed_well(packing.pack(unique, VOCAB).collect(), {r.doc_id: r.text for r in unique.collect()}) < 0.05
    assert packing.pack(odd, VOCAB).filter("doc_id = 9 and start = 0").count() == 2
    assert packing.pack(odd.filter("false"), VOCAB).count() == 0


def test_differencing_is_even():
    random.seed(5)
    sizes = [random.randint(1, 512) for _ in range(2000)]
    sums = np.bincount(packing.differencing(sizes, 250), weights=sizes, minlength=250)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() < 40
    assert packing.differencing([], 3).tolist() == [] and packing.differencing([5], 1).tolist() == [0]


# --- repetition --------------------------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    random.seed(1)
    for _ in range(400):
        n, k = random.randint(0, 40), random.choice([1, 2, 3, 8])
        seq = [random.randrange(k) for _ in range(n)]
        order, lcp = repetition.suffixes(np.array(seq, np.uint64))
        want = sorted(range(n), key=lambda i: seq[i:])

        def common(i, j, seq=seq):
            return next((c for c in range(len(seq)) if max(i, j) + c >= len(seq) or seq[i + c] != seq[j + c]), 0)

        assert order.tolist() == want
        assert lcp.tolist() == [0] * min(n, 1) + [common(want[i - 1], want[i]) for i in range(1, n)]


def brute_quality(text):
    text = text or ""
    w = split(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts(spark, docs, odd):
    lines = spark.createDataFrame([(50, "same line\nsame line\n \nsame line"), (51, "a # b | c\r\n" * 9)], DOCS)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(lines)
    want = Counter((r.doc_id, *brute_quality(r.text)) for r in both.collect())
    got = repetition.judge(both).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert repetition.judge(odd).columns.count("kept") == 1 and repetition.judge(odd.filter("false")).count() == 0


def test_longest_repeat_and_verdict(spark):
    """The rule that the operator adds, against a search of all pairs of positions."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = [f"u{i}_{k}" for k in range(rng.choice([30, 120, 400]))]
        cut = rng.choice([0, 5, 9, 30, 41, 60])
        rows.append((i, " ".join(text + ["mid"] + text[3 : 3 + cut])))
    for r in repetition.judge(spark.createDataFrame(rows, DOCS)).collect():
        w = split(rows[r.doc_id][1])
        long = 0
        for a, b in itertools.combinations(range(len(w)), 2):
            if w[a] == w[b]:
                n = next((n for n in range(len(w) - b) if w[a + n] != w[b + n]), len(w) - b)
                long = max(long, n)
        failed = brute_quality(rows[r.doc_id][1])[5]
        assert r.longest_repeat == long and r.kept == (not failed and not (long > 40 and 100 * long > 15 * len(w)))


# --- personal data -----------------------------------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for place, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), place, kind, m.end()))
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out)).encode()).hexdigest(), Counter(o[2] for o in out)


def test_pii_equals_plain_expressions(spark, docs, odd):
    random.seed(4)
    bits = ["a@b.cc", "x.y@z-1.org", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", " ", "-", ".", "+", "@", "_", "%", "é", "12", "7", "0000000000000000", "\n", "a", "word", "..", "😀", "001.002.0000000003.4", "99999999999999999999.1.1.1"]
    made = [(10**6 + i, "".join(random.choice(bits) for _ in range(random.randint(0, 25)))) for i in range(600)] + [(2 * 10**6, "a" * 50_000), (2 * 10**6 + 1, "1" * 50_000), (2 * 10**6 + 2, "1 " * 20_000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, DOCS)).unionByName(odd.select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in pii.digest(both).collect():
        digest, count = brute_pii(texts[r.doc_id])
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) == (digest, *(count[k] for k in PII)), texts[r.doc_id][:200]


def test_pii_checksums_context_and_masks(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32 end"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "number 123-45-6789"), (5, "mail a.b@c.de, card 4111 1111 1111 1111!"), (6, None)]
    got = {r.doc_id: r for r in pii.with_spans(spark.createDataFrame(rows, DOCS)).select("doc_id", pii.named(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[1].s == "iban:5:32" and got[2].s == "" and got[3].s == "ssn:4:15" and got[4].s == ""
    assert got[5].t == "mail <EMAIL>, card <CARD>!" and got[1].t == "iban <IBAN> end" and got[6].t is None


def test_pii_plan_is_native(docs):
    plan = pii.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_learns_from_two_thirds(spark):
    random.seed(6)
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ord" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = random.choices(base, k=40)
        toxic = i % 3 == 0
        if toxic:
            w[random.randrange(40)] = random.choice(["nastor", "nastorix", "vilegg"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grammar = toxicity.train(docs, marks)
    assert any(s.startswith("nasto") for s in grammar.stems) and any(s.startswith("vile") for s in grammar.stems)
    got = toxicity.score(docs, grammar).withColumn("out", toxicity.held_out("doc_id")).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in got) and {r.doc_id for r in got if r.out} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_clause_machine():
    g = toxicity.Grammar({"idiot": 2.0})
    run = lambda t: toxicity.matches(t, toxicity.Entries(g))
    assert run("a fine day") is None and run(None) is None and run("") is None
    assert run("what an idiot")[0] == 2 and run("you are an idiot")[1] == 2
    assert run("he is not an idiot")[2] == 2 and run("she said he is an idiot")[3] == 2
    assert run("not now. idiot")[0] == 2 and run("i will kill you")[4] == 1 and run("i will kill time")[4] == 0


def spelled_out(symbols: list[str]) -> list[str]:
    """The classes of one clause's matches, by plain rules over its whole sequence of symbols."""
    out = []
    for i, x in enumerate(symbols):
        negated = "negation" in symbols[max(0, i - toxicity.REACH) : i]
        reported, aimed = "report" in symbols[:i], "target" in symbols
        if x == "insult":
            out.append("negated" if negated else "reported" if reported else "aimed" if aimed else "plain")
        elif x == "threat" and aimed and not negated and not reported:
            out.append("threat")
    return out


def test_composed_grammar_against_plain_rules():
    rng = random.Random(3)
    kinds = ["none", "none", "insult", "threat", "target", "negation", "report"]
    for _ in range(3_000):
        symbols = rng.choices(kinds, k=rng.randint(0, 9))
        path = toxicity.CLAUSE.best([[(x, 1.0)] for x in symbols])
        assert len(path) == len(symbols) and [out for out, _ in path if out != "none"] == spelled_out(symbols), symbols
    # Of two readings of a word the one on the better path counts.
    both = toxicity.CLAUSE.best([[("target", 2.0), ("negation", 1.0)], [("insult", 1.0)]])
    assert both == [("none", 2.0), ("aimed", 1.0)]


def test_composition_is_running_one_after_the_other():
    a, b = toxicity.negating(), toxicity.reporting()
    rng = random.Random(4)
    for _ in range(500):
        symbols = rng.choices(["none", "insult", "threat", "target", "negation", "report"], k=rng.randint(1, 8))
        middle = [out for out, _ in a.best([[(x, 0.0)] for x in symbols])]
        assert [out for out, _ in a.then(b).best([[(x, 0.0)] for x in symbols])] == [out for out, _ in b.best([[(x, 0.0)] for x in middle])]


def test_clause_classes_decide_on_held_out_texts(spark):
    rng = random.Random(11)
    filler = [a + b + c for a in "ba ko mi tu re lo".split() for b in "nd st rm lv qu".split() for c in "a e i o u ai oa ue".split()]
    insults, say = ["grobnik", "dulsome", "vastard"], lambda k: " ".join(rng.choices(filler, k=k))
    rows, labels = [], []
    for i in range(2_400):
        bad = rng.choice(insults)
        if i % 10 < 2:
            text, toxic = f"{say(9)} {bad} {say(3)}.", 1
        elif i % 10 == 2:
            text, toxic = f"{say(4)} zorp you {say(2)}.", 1  # a threat that no list holds
        elif i % 60 in (3, 43):
            text, toxic = (f"{say(5)} nix {say(1)} {bad} {say(2)}." if i % 60 == 3 else f"{say(2)} quoth {say(5)} {bad}."), 0
        elif i % 10 == 4:
            text, toxic = f"{say(4)} zorp {say(3)}. you {say(3)}.", 0
        else:
            text, toxic = f"{say(12)}.", 0
        rows.append((i, f"{say(8)}. {text} {say(8)}."))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    right = {}
    for by_clause in (True, False):
        grammar = toxicity.train(docs, marks, by_clause=by_clause)
        got = toxicity.score(docs, grammar).withColumn("out", toxicity.held_out("doc_id")).filter("out").collect()
        right[by_clause] = {r.doc_id for r in got if (r.score >= 0.7) == bool(labels[r.doc_id][1])}
        if by_clause:
            assert "zorp" in grammar.others["threat"] and "nix" in grammar.others["negation"] and "quoth" in grammar.others["report"]
            assert len(right[True]) >= 0.99 * len(got)
    changed = right[True] - right[False]
    assert {i % 10 for i in changed} >= {2, 3} and len(changed) >= 0.05 * len(got) and not right[False] - right[True]


def test_negated_insults_never_add(spark):
    """Labels that go against the grammar's signs give a weight of 0, not a wrong one."""
    rng = np.random.default_rng(10)
    sums = [[float(rng.integers(0, 3)), 0.0, float(rng.integers(0, 3)), float(rng.integers(0, 2)), float(rng.integers(0, 2))] for _ in range(400)]
    x = np.array([toxicity.features(s) for s in sums])
    for sign in (1, -1):  # toxic with, or without, negated insults and threats
        y = np.array([float(sign * (s[2] + s[4] - 2) > 0) for s in sums])
        w = toxicity._fit(x, y)
        assert (w * toxicity.SIGNS >= -1e-9).all() and len(w) == len(toxicity.CLASSES) + 2
        plain, negated = (toxicity.features([1.0, 0.0, n, 0.0, 0.0]) - toxicity.features([1.0 + n, 0.0, 0.0, 0.0, 0.0]) for n in (0.0, 1.0))
        assert negated @ w <= 1e-9 and abs(plain @ w) < 1e-9  # the same insults, one of them negated, are never worse
    assert (toxicity._fit(x, (x[:, 0] > 1.2).astype(float))[0]) > 0


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([(1, 1, None), (None, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, none)).collect()
    assert len(got) == len(ODD) and all(r.score == 0.0 for r in got)
    assert toxicity.score(odd.filter("false"), toxicity.Grammar()).count() == 0


# --- importance --------------------------------------------------------------------------------------------------


def test_importance_prefers_the_target_and_samples_k(spark):
    random.seed(8)
    rows = [(i, " ".join(random.choices(["alpha", "beta", "gamma", "delta"] if i % 2 else ["junk", "spam", "noise", "alpha"], k=30))) for i in range(400)]
    docs, good = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    got = importance.resample(docs, good, keep_percent=50).collect()
    assert sum(r.kept for r in got) == 200 and all(r.kept == bool(r.doc_id % 2) for r in got)
    best = sorted(got, key=lambda r: (-r.gumbel_key, r.doc_id))[:200]
    assert {r.doc_id for r in best} == {r.doc_id for r in got if r.kept}


def test_importance_weights_equal_plain_counting(spark):
    rows = [(1, "a b"), (2, "A b c"), (3, None), (4, "c")]
    docs, good = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1,)], "doc_id long")
    n = importance.n_buckets(docs)

    def grams(text):
        import pyarrow as pa

        found, at = importance.buckets(pa.array([text], pa.string()), n)
        return found.tolist()

    raw, target = np.ones(n), np.ones(n)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i == 1
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in importance.resample(docs, good, keep_percent=50).collect():
        g = grams(dict(rows)[r.doc_id])
        assert r.n_grams == len(g) and math.isclose(r.log_weight, sum(ratio[g]), abs_tol=1e-12)
    assert [len(grams(t)) for _, t in rows] == [3, 5, 0, 1]


def test_importance_weights_equal_counting_words(spark):
    """Without the operator's buckets: n-grams as strings; so few of them share no bucket."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("red green blue Tall small".split(), k=12))) for i in range(30)]
    good = set(range(0, 30, 4))
    grams = {i: [*(w := lower(t).split()), *zip(w, w[1:], strict=False)] for i, t in rows}
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for i in good for g in grams[i])
    docs = spark.createDataFrame(rows, DOCS)
    total, wanted = (sum(c.values()) + importance.n_buckets(docs) for c in (raw, target))
    got = {r.doc_id: r for r in importance.resample(docs, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    for i, _ in rows:
        want = sum(math.log((target[g] + 1) / wanted) - math.log((raw[g] + 1) / total) for g in grams[i])
        assert got[i].n_grams == 23 and math.isclose(got[i].log_weight, want, abs_tol=1e-9)
    noise = np.array([r.gumbel_key - r.log_weight for r in importance.resample(spark.range(20_000).selectExpr("id as doc_id", "'' as text"), spark.createDataFrame([], "doc_id long")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.var() - math.pi**2 / 6) < 0.06  # a standard Gumbel variable


def test_kth_largest_with_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 5)
    values = [(float(i // 3), i) for i in range(60)]
    df = spark.createDataFrame(values, "v double, t long")
    want = sorted(values, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 7, 30, 60):
        assert importance.kth_largest(df, k, "v", "t") == want[k - 1]
    assert importance.kth_largest(df, 61, "v", "t") is None and importance.kth_largest(df, 0, "v", "t") is None


def test_importance_buckets_grow_with_the_texts(spark):
    texts = spark.createDataFrame([(None, 0), ("ä", 1), ("x" * 1000, 68_000)], "text string, times int")
    grown = [importance.n_buckets(texts.filter(F.col("times") <= n).withColumn("copy", F.explode(F.sequence(F.lit(0), "times")))) for n in (-1, 0, 1, 68_000)]
    assert grown == [8192, 8192, 16_384, 32_768]  # no rows, no text, a few bytes, 68 MB: 8192 + 8246


def test_importance_of_odd_rows(odd, spark):
    got = importance.resample(odd, spark.createDataFrame([], "doc_id long")).collect()
    assert len(got) == len(ODD) and all(r.log_weight == 0 for r in got)
    assert importance.resample(odd.filter("false"), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


# --- urls and pages ----------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("example.org/a/b", "block"), (None, "block")], "rule string, verdict string")
    urls_ = {
        "http://example.com/en/x": ("example.com/en/", "block"), "HTTP://A.Example.COM/en/?q": ("example.com/en/", "block"), "https://www.example.com/en/x/y": ("www.example.com/en/", "allow"),
        "https://b.www.example.com/en/": ("www.example.com/en/", "allow"), "https://notexample.com/en/": ("com/", "allow"), "http://example.com": (None, "allow"), "http://x.net/es/1#a": ("net/es/", "block"), "http://x.net/es": (None, "allow"),
        "http://q.example.org/a/bc": ("example.org/a/b", "block"), "http://q.example.org/a/c": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"), "http://?x": (None, "allow"), "http://com/": ("com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate([*urls_, *urls_])], "page_id long, url string, verdict string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == 2 * len(urls_)
    for r in got:
        assert (r.rule, r.verdict) == [*urls_.values(), *urls_.values()][r.page_id], r
    assert urls.judge(pages.filter("false"), rules).count() == 0 and {r.verdict for r in urls.judge(pages, rules.filter("false")).collect()} == {"allow"}


def test_long_urls_and_many_rules(spark, monkeypatch):
    rules = [("com/", "allow"), ("b.com/x/y/z", "block"), *((f"h{i}.net/p/", "block") for i in range(300))]
    long = ["http://" + "a." * 100_000 + "b.com/x/y/zz" + "/k" * 100_000, "http://h7.net/p" + "/" * 100_000, "http://h7.net/q" + "/" * 100_000]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate([*long, None, "http://h299.net/p/", "x", None])], "page_id long, url string, best string")
    for bound in (200_000, 10):
        monkeypatch.setattr(urls, "BROADCAST_RULES", bound)
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
        assert got == {0: ("b.com/x/y/z", "block"), 1: ("h7.net/p/", "block"), 2: (None, "allow"), 4: ("h299.net/p/", "block"), 3: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}


def test_url_query_equals_sql(spark, sf_dir):
    from compare import differences

    from fernwood.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert differences(queries.QUERIES[name](spark, sf_dir), sf_dir, sql) == ""


def page(i, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><script>var a = "</p>" + {i};</script><style>p{{}}</style></head><body><nav><ul><li><a href="/{i}">menu {i}</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><div class="x9">Subscribe to our letter today</div>{extra}<main><h1>Title &amp; {i}</h1>{body}<div class="comments"><p>nice post {i}</p></div></main><footer>foot {i}</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"http://host.example/{i}", page(i, f"<p>Body   of {i}\n continues<br>here.<p>Second &#233; {i}.</p>")) for i in range(12)]
    rows += [(100, "http://host.example/a", None), (101, None, "<article><p>no host</article>"), (102, "http://o.example/", "<p>cut &amp; of<b"), (103, "http://o.example/", "")]
    got = {r.page_id: r for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))).collect()}
    for i in range(12):
        assert got[i].text == f"Title & {i}\nBody of {i} continues here.\nSecond é {i}." and got[i].n_chars == len(got[i].text)
    assert got[100].text == "" and got[101].text == "no host" and got[102].text == "cut & of" and got[103].n_chars == 0


def test_template_wording_goes_without_names(spark):
    rows = [(i, f"http://h.example/{i}", f'<body><div class="q1">Same words on every page</div><div class="q2"><p>Own text number {i}.</p></div><div class="q3"><a href=x>link {i}</a> <a href=y>more {i}</a></div></body>') for i in range(20)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own text number {i}." for i in range(20)}


def test_template_beside_fixed_lists(spark):
    ends = "<ul><li><div><a href=/>Home</a></div></li><li><div><a href=/a>About</a></div></li></ul>", "<div><p>All rights kept</p><p>Written by us</p></div>"
    rows = [(i, f"http://h.example/{i}", f'<html><body>{ends[0]}<div class="q1">Same words on every page</div><div class="q2"><p>Own text number {i}.</p></div>{ends[1]}</body></html>') for i in range(20)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own text number {i}." for i in range(20)}


def test_template_of_two_pages_and_its_slots(spark):
    links = "".join(f"<li><a href=/{k}>link {{0}} {k}</a></li>" for k in range(3))
    rows = [(i, f"http://h{i // 2}.example/{i}", f'<div class="q1">Same words here</div><div class="q2"><p>Own text number {i}.</p></div><ul class="q3{" b" * (i % 2)}">{links.format(i)}</ul>') for i in range(6)]
    got = templates.extract(spark.createDataFrame(rows + [(9, "http://one.example/", "<p>Alone</p>")], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.split("\n")[0] for r in got} == {i: f"Own text number {i}." for i in range(6)} | {9: "Alone"}
    rows = [(i, f"http://h{i // 2}.example/{i}", h.replace(" b", "")) for i, _, h in rows]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own text number {i}." for i in range(6)}


def test_template_takes_long_wording_but_no_copied_article(spark):
    notice = "<div class=q1>" + "All of this legal text stands here. " * 20 + "</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{notice}<div class=q2><p>Own text number {i}.</p></div></body>") for i in range(20)]
    rows += [(i, f"http://c.example/{i}", "<article><p>One page in many copies.</p></article>" if i > 125 else f"<article><p>Own {i}.</p></article>") for i in range(120, 160)]
    rows += rows[-1:] * 2
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert all(r.text == (f"Own text number {r.page_id}." if r.page_id < 100 else "One page in many copies." if r.page_id > 125 else f"Own {r.page_id}.") for r in got)


def template_pages(host: str, n: int) -> list[tuple[int, str, str]]:
    """Pages in two layouts without a telling name: links, a notice on some pages, an article, remarks, a foot."""
    out = []
    for i in range(n):
        links = "".join(f"<li><a href=/{k}>to {k} {i % 3}</a></li>" for k in range(4))
        note = "<div class=q2><p>Read what we keep of you.</p></div>" if i % 2 else ""
        paragraphs = "".join(f"<p>Sentence {i} {k} of an article that goes on for a while.</p>" for k in range(1 + i % 4))
        body = f"<section class=q3><h1>Title {i}</h1><div class=q4>{paragraphs}</div></section>" if i % 3 else f"<div class=w><div class=q7><h2>Title {i}</h2>{paragraphs}</div></div>"
        remarks = "".join(f"<div class=q6><b>Someone {i}</b><p>Remark {i} {k}</p></div>" for k in range(i % 3))
        out.append((i, f"http://{host}/{i}", f"<html><body><ul class=q1>{links}</ul>{note}{body}<div class=q5>{remarks}</div><div class=q8>All rights kept, {i % 2}</div></body></html>"))
    return out


def test_template_alone_finds_the_article(spark):
    rows = template_pages("h.example", 24)
    want = {i: "\n".join([f"Title {i}", *(f"Sentence {i} {k} of an article that goes on for a while." for k in range(1 + i % 4))]) for i in range(24)}
    pages = spark.createDataFrame(rows + rows[3:4] * 30, "page_id long, url string, html string")
    for names in (True, False):
        got = templates.extract(pages, names=names).collect()
        assert len(got) == 54 and {r.page_id: r.text for r in got} == want
    bare = {i: templates.main_text(h, templates.Template()) for i, _, h in rows}
    assert all(bare[i] != want[i] for i in want)  # without a template, nothing tells the article from the rest


def test_template_classes_against_explicit_vectors(spark):
    rows = template_pages("h.example", 9) + template_pages("g.example", 2)
    got = {r.site: r for r in templates.templates(spark.createDataFrame([(i, u, u.split("/")[2], h) for i, u, h in rows], "page long, url string, host string, html string"), names=False).collect()}
    sites = {r.host: r.site for r in spark.createDataFrame([("h.example",), ("g.example",)], "host string").withColumn("site", F.xxhash64("host")).collect()}
    for host in sites:
        htmls = [h for _, u, h in rows if f"/{host}/" in u]
        count: dict = {}  # token -> its occurrence vector, page by page
        for p, h in enumerate(htmls):
            opened, blocks = templates.read(h, names=False)
            for token in [(0, 0, False), *((f.path, f.up.path, False) for f in opened), *((templates.token_hash(str(f.path), t), f.path, True) for f, t, _ in blocks)]:
                count.setdefault(token, [0] * len(htmls))[p] += 1
        pages = {t: sum(map(bool, v)) for t, v in count.items()}
        valid = {0}
        while True:
            grown = {t for t, up, w in count if not w and up in valid and pages[t, up, w] >= 2} - valid
            if not grown:
                break
            valid |= grown
        tag = {t: v for (t, _, w), v in count.items() if not w}
        wording = {t for (t, up, w), v in count.items() if w and up in valid and pages[t, up, w] >= 2 and (v == tag[up] or (pages[t, up, w] >= 0.8 * len(htmls) and pages[t, up, w] > 2))}
        assert set(got[sites[host]].slots) == valid and set(got[sites[host]].wording) == wording and (wording or host[0] == "g")


def test_extraction_of_odd_pages(spark):
    long = "<html><body><article><p>" + "word " * 200_000 + "</p></article>" + "<div>" * 3_000
    rows = [(1, "http://h.example/1", long), (2, "http://h.example/2", None), (None, None, "<p>Alone &amp; free</p>"), (4, "http://h.example/4", "")]
    rows += [(5, "http://r.example/5", "<p>x</p>")] * 10
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"site": F.lit("own"), "wording": F.lit(1), "text": F.lit(2)})
    got = templates.extract(frame).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 12), (1, 999_999), (2, 0), (4, 0)] + [(5, 1)] * 10
    assert templates.extract(frame.filter("false")).collect() == []


def test_extraction_keeps_article_text(spark):
    kept = ["<body class='no-sidebar with-nav'><article>{}</article>", "<div class='page sidebar'><div class=nav><main>{}</main></div></div>", "<main class=with-nav style='overflow:hidden'>{}</main>", "<div class=overflow-hidden>{}</div>", "<div data-note=hidden>{}</div>"]
    gone = ["<div hidden>x</div>", "<div style='color:red; display: none'>x</div>", "<div style=visibility:hidden>x</div>", "<main><div class=comments><article>x</article></div></main>", "<div class=sidebar>x</div>", "<div aria-hidden=true>x</div>"]
    for k, form in enumerate(kept):
        assert templates.main_text(form.format(f"<p>Text {k}</p>"), templates.Template()) == f"Text {k}", form
    assert [templates.main_text(form, templates.Template()) for form in gone] == [""] * len(gone)
    refs = "<ul><li><a href=x>Linked reference {0}</a></li><li>Plain {0}</li></ul>"
    rows = [(i, f"http://h.example/{i}", f"<ul class=m><li><a href=x>menu {i}</a></li></ul><article><p>Own {i}.</p>{refs.format(i)}</article>") for i in range(20)]
    rows += [(i, f"http://g.example/{i}", f"<ul class=m><li><a href=x>menu {i} of many</a></li><li>Note {i}</li></ul><p>Own {i}.</p>") for i in range(20, 40)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own {i}.\nLinked reference {i}\nPlain {i}" if i < 20 else f"Note {i}\nOwn {i}." for i in range(40)}


def test_fixed_wording_of_an_article_stays(spark):
    """Subheadings and sentences that stand on all pages of a host, in articles with and without a telling tag."""
    named = "<nav><a href=/>Home</a></nav><article><h1>Title {0}</h1><h2>Summary</h2><p>Own text {0} of this page.</p><h2 class=m>Methods</h2><p>As always.</p><p>More of {0}.</p></article><footer>All rights kept.</footer>"
    bare = "<ul class=q1><li><a href=/>Home</a></li></ul><div class=q2><h1>Title {0}</h1><h2>Summary</h2><p>Own text {0} of this page, which is long enough to be most of it.</p><h2>Methods</h2><p>More of {0}.</p></div><div class=q3>All rights kept.</div>"
    rows = [(i, f"http://a.example/{i}", named.format(i)) for i in range(10)] + [(i, f"http://b.example/{i}", bare.format(i)) for i in range(10, 20)]
    rows += [(i, f"http://c.example/{i}", f"<article><h2>Results</h2><p>Text {i} of two pages.</p></article>") for i in (20, 21)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nSummary\nOwn text {i} of this page.\nMethods\nAs always.\nMore of {i}." for i in range(10))
    assert all(got[i] == f"Title {i}\nSummary\nOwn text {i} of this page, which is long enough to be most of it.\nMethods\nMore of {i}." for i in range(10, 20))
    assert all(got[i] == f"Results\nText {i} of two pages." for i in (20, 21))


def test_depth_costs_nothing(spark):
    n = 50_000
    deep = ["<div>x" * n, "<div>" * n + "</span2></b2>" * n + "y", "<div>" * n + "<article><p>z</p></article>" * n, "<p class=a>" * n + "</p>" * n]
    began = time.perf_counter()
    texts = [templates.main_text(h, templates.Template()) for h in deep]
    tokens = [sum(1 for _ in templates.tally(h, 1, True)) for h in deep]
    assert time.perf_counter() - began < 30
    assert [len(t.split()) for t in texts] == [n, 1, n, 0] and tokens[0] == 2 * n + 1
    got = templates.extract(spark.createDataFrame([(i, f"http://h.example/{i % 2}", h) for i, h in enumerate(deep)], "page_id long, url string, html string")).collect()
    assert len(got) == 4


# --- neighbours --------------------------------------------------------------------------------------------------


def test_neighbours_recall_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 300)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[500:900] = v[0]  # one vector fills over a quarter of the table
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (None, [1.0] * 16), (5050, [])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, query=F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    hit = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5].tolist()
        hit += len(set(best) & {k for k, _ in found})
        assert len(found) == 5 and all(math.isclose(s[k], x, abs_tol=1e-9) for k, x in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [k for k, _ in got[0]] == [500, 501, 502, 503, 504] and [k for k, _ in got[600]] == [0, 500, 501, 502, 503]


def test_neighbours_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(few, k=5, query=F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert neighbours.nearest(few.filter("false"), query=F.lit(True)).count() == 0


def test_neighbours_prune_and_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found, verified = neighbours.searched(rows, k=5, query=F.col("id") % 50 == 0)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    kept = [(r.vec_id, r.embedding) for r in rows.collect() if r.embedding and None not in r.embedding and any(r.embedding)]
    ids, u = np.array([i for i, _ in kept]), np.array([v for _, v in kept], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    queries = np.flatnonzero(ids % 50 == 0)
    want = {(int(ids[q]), int(ids[j])) for q in queries for j in np.argsort(-np.where(ids == ids[q], -9, u @ u[q]))[:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert verified.agg(F.sum("verified")).first()[0] <= 0.5 * len(queries) * len(ids)


def test_neighbours_verify_a_falling_share(spark):
    """Clustered vectors of two sizes: recall stays, the share of rows verified falls."""
    shares = []
    for n in (2_000, 8_000):
        rng = np.random.default_rng(9)
        u = rng.standard_normal((40, 32))[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, 32))
        found, verified = neighbours.searched(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "vec_id long, embedding array<double>"), k=5, query=F.col("id") % 50 == 0)
        got = {(r.query_id, r.vec_id) for r in found.collect()}
        u /= np.linalg.norm(u, axis=1)[:, None]
        want = {(q, int(j)) for q in range(0, n, 50) for j in np.argsort(-np.where(np.arange(n) == q, -9, u @ u[q]))[:5]}
        assert len(got & want) >= 0.9 * len(want)
        shares.append(verified.agg(F.sum("verified")).first()[0] / (n // 50 * n))
    assert shares[1] < shares[0] < 0.3


def test_copies_of_a_row_make_no_hot_group(spark):
    """9,001 equal rows are one row before anything is dealt out."""
    rows = [(i, np.random.default_rng(i).standard_normal(8).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows + rows[:1] * 9_000, "vec_id long, embedding array<double>")
    kept = neighbours._rows(table, "vec_id", "embedding", "<f8")
    assert kept.count() == 300
    got, plain = (sorted(map(tuple, neighbours.nearest(t, k=5, query=F.col("id") % 50 == 0).collect())) for t in (table, spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == plain


def test_neighbours_of_repeated_and_odd_rows(spark):
    v = np.random.default_rng(4).standard_normal((40, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    plain = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, query=F.col("id") % 50 == 0).collect()
    odd = spark.createDataFrame(rows + rows[:3] * 2 + [(90, [1.0] * 9), (91, [2.0] * 7)], "vec_id long, embedding array<double>").withColumns({"cell": F.lit("own"), "id": F.lit(1), "number": F.lit(2)})
    got = neighbours.nearest(odd, k=3, query=F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(plain) == 3
    exact = sorted(((-float(r @ v[0] / np.linalg.norm(r) / np.linalg.norm(v[0])), i) for i, r in enumerate(v) if i))[:3]
    assert [(r.vec_id, round(r.score, 12)) for r in sorted(plain, key=lambda r: r["rank"])] == [(i, round(-s, 12)) for s, i in exact]
    two = neighbours.nearest(odd.unionByName(odd.filter("vec_id = 5").selectExpr("0L as vec_id", "embedding", "cell", "id", "number")), k=3, query=F.col("id") == 0).collect()
    assert sorted(r["rank"] for r in two) == [1, 1, 2, 2, 3, 3] and all(r.vec_id != 0 for r in two)  # two vectors under one key: each is answered


def test_chi_square_quantile():
    assert math.isclose(neighbours.chi_square_quantile(0.95, 8), 15.507, abs_tol=1e-3) and math.isclose(neighbours.chi_square_quantile(0.99, 2), 9.210, abs_tol=1e-3)


# --- words and pipeline ------------------------------------------------------------------------------------------


def test_words_from_arrow():
    import pyarrow as pa

    column = pa.array(["skip", "a  bc\n", None, "é d", "", "x" * 600 + " y"], pa.string()).slice(1)
    raw, at = words.text_bytes(column)
    starts, ends, first = words.word_spans(raw, at)
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bc", "é", "d", "x" * 600, "y"]
    assert first.tolist() == [0, 2, 2, 4, 4, 6] and len(set(words.word_hashes(raw, starts, ends).tolist())) == 6


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, own = own, pipeline.written(stage(spark, own, sf_dir), name)
        assert own.columns == docs.columns and own.dtypes == docs.dtypes
        left = {r.doc_id: r.text for r in before.collect()}
        now = {r.doc_id: r.text for r in own.collect()}
        if name == "quality_rules":
            assert all(brute_quality(t)[5] is False for t in now.values())
        if name == "ngram_jaccard_join":
            assert set(now) == {k for k, (_, top) in brute_components(list(left.items()), 5, 80).items() if k == top}
        if name == "pii":
            assert set(now) == set(left) and all(not brute_pii(t)[1] for t in now.values())
            assert {r.doc_id: r.n_chars for r in own.collect()} == {k: len(t) for k, t in now.items()}
    final = pipeline.STAGES[-1][1](spark, own, sf_dir).collect()
    assert packed_well(final, {r.doc_id: r.text for r in own.collect()}) < 0.01
    assert Counter(tuple(r)[:5] for r in pipeline.run(spark, sf_dir).collect()) == Counter(tuple(r)[:5] for r in final)


def test_pipeline_leaves_other_columns_alone(spark, sf_dir):
    import corpus_pipeline as pipeline

    clashing = ["score", "n_words", "kept", "spans", "_text", "_row", "id", "place", "component_id", "sheltered", "_pii_ip", "base_failed", "hash", "longest_repeat", "key"]
    words_of = "every good article has words of its own that tell what no other article told before in quite this way or order".split()
    rows = [(i, " ".join(random.Random(i).sample(words_of, 22)) + f" mail a{i}@b.org") for i in range(12)]
    rows += [(None, None), (None, " ".join(words_of)), (3, rows[3][1]), (40, ""), (41, rows[5][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in clashing}).select(*clashing[:7], "doc_id", *clashing[7:], "text")
    assert "n_chars" not in docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs, before = pipeline.written(stage(spark, docs, sf_dir), name), docs
        assert docs.dtypes == before.dtypes
        assert all(r[c] == f"{c} of {-1 if r.doc_id is None else r.doc_id}" for r in docs.collect() for c in clashing)
    left = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [*((False, i) for i in range(12)), (True, 0)]
    assert all(r.doc_id is None or r.text.endswith("mail <EMAIL>") for r in left)
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r.length for r in packed) > 100


def test_pipeline_of_an_empty_table(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_pipeline_keeps_one_of_repeated_and_null_ids(spark):
    import corpus_pipeline as pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(3, a), (3, a), (7, a), (None, a), (None, b), (None, b), (9, b), (None, c), (None, c), (5, d), (5, d + " more"), (8, c + " x y z " + a), (8, "one other text of its own"), (None, None), (None, None)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    left = [tuple(r) for r in got.collect()]
    assert got.columns == ["doc_id", "text"] and len(left) == 8
    assert {(3, a), (9, b), (None, c), (8, rows[11][1]), (8, rows[12][1])} < set(left) and left.count((None, None)) == 2 and sum(i == 5 for i, _ in left) == 1


def test_registered_queries(spark, sf_dir):
    """Every registered query over its whole table, against the plain versions."""
    import __spark_entry__ as driver

    names = {int(n[2:].split("_")[0]): q for n, q in driver.queries().items() if n.startswith("op") and n[2].isdigit()}
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    texts, pages = {r.doc_id: r.text for r in table("documents")}, {r.page_id: r for r in table("pages")}
    got = {n: names[n](spark, sf_dir).collect() for n in names}
    for n in (1, 3, 6, 7, 8, 10):
        assert sorted(r.doc_id for r in got[n]) == sorted(texts), n
    assert sum(r.kept for r in got[1]) == int(0.85 * len(texts))
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]) for r in got[3])
    assert {r.page_id: r.url for r in got[4]} == {i: p.url for i, p in pages.items()} and all(r.n_chars == len(r.text) for r in got[4])
    for r in got[4]:
        body = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html or "")
        if body:  # all of the article's text, markup and what is no article by its tag aside
            plain = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<(aside|form|nav|footer)\b.*?</\1>|<[^>]*>", " ", body[1])
            assert "".join(r.text.split()) == "".join(html.unescape(plain).split())
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in table("embeddings") if r.embedding]
    asked = {i for i, v in vectors if i % 50 == 0}
    assert Counter(r.query_id for r in got[5]) == dict.fromkeys(asked, 5)
    by_id = dict(vectors)
    assert all(math.isclose(r.score, by_id[r.query_id] @ by_id[r.vec_id] / np.linalg.norm(by_id[r.query_id]) / np.linalg.norm(by_id[r.vec_id]), abs_tol=1e-9) for r in got[5])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got[7]} == brute_components(list(texts.items()), 3, 90)
    lib = Tokenizer.from_file(VOCAB)
    assert all(r.n_tokens == len(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in got[8])
    assert packed_well(got[9], texts) < 0.01
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got[10])


def test_entry_registers_every_operator():
    import __spark_entry__ as driver

    names = driver.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in names
