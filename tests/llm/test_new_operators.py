"""Source divergence, hard negatives and chat formatting: against plain versions, SQL and round trips; defined results of odd input."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernwood.llm import chat, divergence, negatives, queries


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives", "op13_chat_formatting"])
def test_query_equals_sql(spark, name):
    at = "/root/testdata/sf0.01"
    assert differences(queries.QUERIES[name](spark, at), at, queries.ORACLE_SQL[name]) == ""


# --- source divergence -------------------------------------------------------------------------------------------


def plain_audit(rows, least, shown):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least}

        def rates(count, kept=kept):
            size = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // size for t in kept}

        own = rates(counts[lang, source])
        whole = rates(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        others = [(g, sum(abs(own[t] - p) for t, p in rates(counts[lang, g]).items())) for x, g in groups if x == lang and g != source]
        over = [(t, own[t] - whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", others, None), ("term", over, shown)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_audit_equals_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 40)
    monkeypatch.setattr(divergence, "CELLS", 30)  # many blocks
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}{'é' * (i % 3)}" for i in range(26)] + ["Ünï", "İ", "x" * 3000, "日本"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30)).tolist()) + "-A'b 7", str(rng.choice(["en", "de"])), f"s{rng.integers(0, 6)}") for _ in range(150)]
    rows += [("the same Text", "en", "hot")] * 90 + [("the same Text", "en", f"s{i}") for i in range(4)]  # copies within and between sources
    rows += [(None, None, None), ("", "", "a"), (" \n", "fr", "a"), ("only here", "fr", "b"), ("x", None, "a"), (None, "en", "empty")]
    table = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("own"), "count": F.lit(1), "n": F.lit(2), "digest": F.lit(3)}).repartition(5)
    got = sorted(map(tuple, divergence.audit(table, least=4, shown=5).collect()))
    assert got == plain_audit(rows, 4, 5)
    assert ("fr", "a", "pair", "b", 0, 1) in got and any(r[3] == "ünï".replace("ü", "Ü") for r in divergence.term_counts(table).select("lang", "source", "count", "term").collect())
    assert divergence.audit(table.filter("false")).count() == 0


def test_copies_are_tokenized_once(spark, monkeypatch):
    rows = [(f"text {'abc'[i % 3]}", "en", f"s{i % 4}") for i in range(600)]
    near = divergence._collapsed(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)).collect()
    bodies = Counter(bytes(r.body) for r in near if r.body is not None)
    assert len(bodies) == 3 and max(bodies.values()) <= 4 and sum(r.n for r in near) == 600  # a task sends a text once


# --- hard negatives ----------------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, kept=3):
    rows = sorted({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows})
    out = []
    for i, lab, v in rows:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i)
            for s, j in [(-s, j) for s, j, other in scored if other == lab][:positives]:
                fits = [(-t, n) for t, n, other in scored if other != lab and 50 * s <= -100 * t <= 95 * s][:kept]
                out += [(i, j, r, n, s, t) for r, (t, n) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", ["float", "double"])
def test_negatives_equal_brute_force(spark, monkeypatch, size):
    for name, value in (("MEMBERS", 2), ("BAND", 64), ("STRIDE", 16), ("CHUNK", 2), ("CLUSTERS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((4, 12))
    v = (centre[rng.integers(0, 4, 700)] + 0.4 * rng.standard_normal((700, 12))).astype(np.float32).astype(np.float64)
    v[200:400] = v[0]  # a vector that fills a third, over several labels
    v[650], v[13] = 0, -v[0]
    rows = [(i, int(rng.integers(0, 4)), x.tolist()) for i, x in enumerate(v)]
    if size == "double":
        rows += [(5000, 1, (1e6 * v[0]).tolist()), (5050, 2, [2.0**21] * 12)]  # products past 2^53
    odd = rows + rows[:60] + [(None, 1, [1.0] * 12), (7000, None, [1.0] * 12), (7050, 1, None), (7100, 1, []), (7150, 1, [float("nan")] * 12), (7200, 2, [1.0] * 11), (7250, 1, [None] * 12), (7300, 1, [float("inf")] * 12)]
    table = spark.createDataFrame(odd, f"vec_id long, label int, embedding array<{size}>").withColumns({c: F.lit("own") for c in ("id", "v", "cluster", "number", "norm")})
    found, walked = negatives.mined(table, anchor=F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)
    assert walked.agg(F.sum("walked")).first()[0] > 0


def test_negatives_of_few_rows(spark):
    few = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.8, 0.1]), (50, 3, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, negatives.hard_negatives(few, anchor=F.col("id") % 50 == 0).collect())) == [(0, 1, 1, 2, 65536, 52224)]
    assert negatives.hard_negatives(few, anchor=F.lit(False)).count() == 0 and negatives.hard_negatives(few.filter("false"), anchor=F.lit(True)).count() == 0


def test_lists_end_early_on_clustered_vectors(spark, monkeypatch):
    """Certified ends: where directions have structure, members compare with a small part of all rows."""
    monkeypatch.setattr(negatives, "BAND", 512)
    monkeypatch.setattr(negatives, "STRIDE", 128)
    monkeypatch.setattr(negatives, "CLUSTERS", 48)
    shares = []
    for n in (3000, 12000):
        rng = np.random.default_rng(7)
        of = rng.integers(0, 24, n)
        v = rng.standard_normal((24, 32))[of] + 0.12 * rng.standard_normal((n, 32))
        table = spark.createDataFrame([(i, int(of[i] % 3 + 3 * (i % 2)), x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
        found, walked = negatives.mined(table, anchor=F.col("id") % 50 == 0)
        shares.append(walked.agg(F.sum("walked")).first()[0] / (2 * n * n / 50))
        assert found.count() > 0
    print(shares)
    assert max(shares) < 0.25


def test_bounds_hold():
    rng = np.random.default_rng(8)
    m = rng.integers(-300, 300, (200, 9))
    m[5] = 0
    a = rng.integers(-300, 300, (20, 9))
    norms = negatives._norms(a)
    centre = negatives.fitted(negatives.unit(a.astype(float), norms), 3)
    close = negatives.unit(a.astype(float), norms) @ centre.T
    of, radius = close.argmax(axis=1), np.zeros(3)
    for c in range(3):
        radius[c] = np.arccos(np.clip(close[of == c, c], -1, 1)).max()
    limit = negatives.bounds(m, centre, radius)
    scores = negatives.products(a, m)
    assert (scores == a @ m.T).all()
    assert all(negatives.reaches(float(norms[i]), float(limit[j, of[i]]), int(scores[i, j])) for i in range(20) for j in range(200))


# --- chat formatting ---------------------------------------------------------------------------------------------

SHAPES = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": None}, {"content": "b", "name": "n"}], "id": 3}, "messages", [("user", ""), ("", "b")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"text": "y"}]}, {"role": "assistant", "content": "z"}]}, "messages", [("user", "xy"), ("assistant", "z")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}], "meta": {"messages": 1}}, "from_value", [("user", "q"), ("assistant", "r"), ("tool", "t")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "from_value", [("system", "s"), ("user", "q")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": 5}, "instruction", [("user", "do"), ("assistant", "5")]),
    ({"prompt": "p", "completion": None}, "prompt_completion", [("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "response": True}, "prompt_response", [("user", "p"), ("assistant", "true")]),
    ({"question": "p", "answer": "x" * 300_000}, "question_answer", [("user", "p"), ("assistant", "x" * 300_000)]),
    ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, "message_pair", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "messages": []}, None, None),
    ({"prompt": {"x": 1}, "completion": "c"}, None, None),
    ({"text": "no chat"}, None, None),
    ([1, 2], None, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(SHAPES)] + [(90, "{broken"), (91, None), (92, "")]
    got = {r.n: r for r in chat.canonical(spark.createDataFrame(rows, "n int, record string").withColumns({"layout": F.lit("own"), "turns": F.lit(1), "paths": F.lit(2), "a.b": F.lit(3)})).collect()}
    for i, (_, layout, turns) in enumerate(SHAPES):
        assert got[i].layout == layout, i
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns, i
    assert all(got[i].layout is None and got[i].turns is None and got[i].paths == 2 and got[i]["a.b"] == 3 for i in (90, 91, 92))
    again = [{"output": "o", "instruction": "i", "other": [1]}, {"instruction": 1, "output": "long " * 99}]
    prints = [r.fingerprint for r in chat.canonical(spark.createDataFrame([(json.dumps(r),) for r in again], "record string")).collect()]
    assert prints[0] == prints[1] == chat.digest({"instruction", "output"})  # a shape has one fingerprint, whatever it holds


def brute_escape(text, control):
    return "".join(c + "\\" if c == "\\" or any(text.startswith(x, i) for x in control) else c for i, c in enumerate(text))


PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "/s>", "\n", "é", "😀", "a", "[", "<\\/s>", "\\\\", "s>", "<|im_end|>", "|", "\r\n", " ", " "]


def test_template_round_trip(spark):
    seen: list[tuple[str, str]] = []

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), st.sampled_from(["assistant", "user", "ro le\n</s>", "", "é%"]))
    def gather(text, role):
        seen.append((role, text))

    gather()
    rows = [(i, seen[i : i + 3]) for i in range(0, len(seen), 3)] + [(-1, []), (-2, None)]
    template = chat.Template()
    out = chat.formatted(spark.createDataFrame(rows, "n int, turns array<struct<role:string,text:string>>").withColumn("formatted", F.lit("own"))).withColumn("back", template.read_back(F.col("formatted")))
    told = {r.n: r for r in out.collect()}
    for n, turns in rows[:-1]:
        assert [tuple(t) for t in told[n].back] == turns
        assert [s.text for s in told[n].segments if s.loss] == [brute_escape(t, template.control) for r, t in turns if r == "assistant"]
        bodies = [s.text for s in told[n].segments][1::3]
        assert not any(c in b for b in bodies for c in template.control)
        assert told[n].formatted == "".join(s.text for s in told[n].segments)
    assert told[-1].formatted == "" and told[-2].segments is None and told[-2].formatted is None


def test_logs_of_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "</s>[INST] ok [/INST]"), (2, 0, None, None), (2, 0, "assistant", "y"), (2, 0, "assistant", "x"), (2, None, "user", "first"), (None, 3, "user", ""), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a\\"), (2, 0, "assistant", "x")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_columns(chat.formatted(chat.canonical(chat.records_of_turns(log)))).collect()}
    want = {1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "b")], 2: [("user", "first"), ("", ""), ("assistant", "x"), ("assistant", "x"), ("assistant", "y")], None: [("user", "")], 4: [("system", "s"), ("user", "u"), ("assistant", "a\\")]}
    assert set(got) == set(want)
    for i, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[i].n_turns, got[i].loss_chars) == (len(turns), len(loss))
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() and got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[i].formatted_chars == sum(len("<s></s>\n" + r + brute_escape(t, chat.Template().control)) for r, t in turns)
    assert {i: r.layout for i, r in got.items()} == {1: "prompt_completion", 2: "messages", None: "messages", 4: "instruction"}
    assert chat.digest_columns(chat.formatted(chat.canonical(chat.records_of_turns(log.filter("false"))))).count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.QUERIES["op13_chat_formatting"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
    with pytest.raises(ValueError):
        chat.Template(control=("<s>",))
