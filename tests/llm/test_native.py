import collections
import hashlib
import re
import zlib

from codeloom.llm import pii
from codeloom.llm.chat import chain, digests, formatted
from codeloom.llm.mixing import mixed, one_period, schedule, shares
from codeloom.llm.numbering import numbered
from codeloom.llm.quality import fenced, quality, sketches, text_stats
from codeloom.llm.sharding import sharded
from codeloom.llm.shared import stage
from helpers import BLANK, ODD, docs

# The base patterns as stated.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, t):
        digits = [int(c) for c in t if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in t.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return True

    # Without the sign that a pattern needs, its plain search would only take quadratic time.
    needs = {"email": "@", "ip": ".", "phone": "+"}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() if needs.get(k, "") in (text or "") for m in re.finditer(p, text or "") if good(k, m.group())]


TRICKY = [
    (20, "a@b.c@d.e_f@g.hé 1.2.3.4.5.6.7.8 😀 x@y.zz +1 (2) 3-4567890 +12 4111 1111 1111 1111 a@@b.c 1.2.3.256 0001.2.3.4"),
    (21, "9" * 5_000 + " " + "x" * 5_000 + "@ " + "1.2.3.4" * 500), (22, "+1 2 3 4 5 6 7 8 9 0 (1) +12345678 +1234567890123456 +1.........2"),
    (23, "4111-1111-1111-1111 4111 1111 1111 1111"), (24, "4111-1111-1111-1111, 378282246310005"), (25, "a.b@c-d.e.f.; @x.y u%+-@1.2"),
]


def test_base_spans_agree_with_python(spark):
    rows = ODD + TRICKY
    out = pii.report(docs(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    left = collections.Counter((i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows)
    for r in out:
        left[(r.doc_id, r.base_sha256)] -= 1
    assert not any(left.values())
    by_id = dict(rows)
    for r in out:
        expected = base_spans(by_id[r.doc_id]) if r.doc_id is not None else []
        if r.doc_id is not None:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in expected) for k in BASE]
            assert set(expected) <= set(r.spans.split(","))


def test_trees_add_look_alikes_and_spare_others(spark):
    rows = [(i, f"alpha beta +1 ({300 + i % 600}) 555-{1000 + i} gamma") for i in range(300)] + [(1000 + i, f"lot {10**8 + i * 7919} sold") for i in range(300)]
    model = pii.fit(docs(spark, rows))
    assert "phone" in model.thresholds
    probe = docs(spark, [(1, "ring (743) 555-3824 today"), (2, "lot 123456789 sold")])
    kinds = {r.doc_id: [KIND.k for KIND in r.pii_all] for r in pii.spans(probe.select("doc_id", "text"), model).collect()}
    assert kinds == {1: [pii.KINDS.index("phone")], 2: []}


def added(spark, rows, model):
    """Texts of the spans that the trees add, by doc_id."""
    base = {i: {tuple(map(int, x.split(":")[1:])) for x in base_spans(t)} for i, t in rows}
    out = pii.spans(docs(spark, rows).select("doc_id", "text"), model).collect()
    return {r.doc_id: [(pii.KINDS[x.k], r.text[x.s : x.e]) for x in r.pii_all if (x.s, x.e) not in base[r.doc_id]] for r in out}


def test_forms_without_labels_in_the_sample_are_no_counter_examples(spark):
    """Three times as many addresses spelt out as written plainly: they are still found, and so is what base rules swallow."""
    rows = [(i, f"{'mail' if i % 2 else 'write'} jo{i}@site{i % 7}.example.org now") for i in range(100)] + [(1000 + i, f"{'mail' if i % 2 else 'write'} jo{i} (at) site{i % 7} (dot) example (dot) org now") for i in range(300)]
    rows += [(2000 + i, f"card 4111 1111 1111 {1111 if i % 2 else 1112} paid, host 10.0.{i}.1 up, ring +1 (300) 555-{1000 + i} soon, token deadbeef{i}12345678") for i in range(120)]
    model = pii.fit(docs(spark, rows))
    assert set(model.thresholds) == set(pii.KINDS)
    probe = [
        (1, "to ann (at) mail3 (dot) example (dot) com today"), (2, "pay 4111111111111111 4012888888881881 and 4111111111111112 x"),
        (3, "ring (743) 555-3824 or +1 (743) 555-3824 4111111111111111 ok"), (4, "lot abc4111111111111111 and deadbeef7435553824"), (5, "host 10[.]0[.]7[.]9 or 300[.]1[.]1[.]1 up"), (6, None), (7, "none"),
    ]
    got = added(spark, probe, model)
    assert got[1] == [("email", "ann (at) mail3 (dot) example (dot) com")]
    assert got[2] == [("card", "4111111111111111"), ("card", "4012888888881881")]
    assert got[3] == [("card", "4111111111111111"), ("phone", "(743) 555-3824"), ("phone", "+1 (743) 555-3824")]
    assert got[4] == [] and got[5] == [("ip", "10[.]0[.]7[.]9")] and got[6] == got[7] == []


def test_thresholds_count_all_documents_but_the_sample(spark):
    counts = [(990, pii.POSITIVE, 500), (600, pii.POSITIVE, 500), (600, pii.NEGATIVE, 1), (300, pii.NEGATIVE, 40), (300, pii.POSITIVE, 5)]
    assert pii._threshold("ip", counts, pii.Limits()) == {"ip": max(0.301, (990 * 500 + 600 * 500 + 300 * 5) / 1005 / 1000 / 2)}
    assert pii._threshold("ip", [(900, pii.NEGATIVE, 5)], pii.Limits()) == {}
    assert pii._threshold("ip", [(900, pii.POSITIVE, 1)], pii.Limits()) == {"ip": 0.45}


def test_redaction_leaves_nothing_and_keeps_other_columns(spark):
    rows = ODD + TRICKY
    df = docs(spark, rows, extra=True)
    out = stage(pii.redacted(df), "redacted")
    assert out.columns == df.columns
    texts = [r.text for r in out.where("doc_id is not null").collect()]
    assert not any(base_spans(t) for t in texts)
    assert "mail [EMAIL] and [CARD] or [PHONE] at [IP]" in texts
    assert out.where("text is null").count() == sum(t is None for _, t in rows)


def test_pii_empty_table(spark):
    assert pii.report(docs(spark, [])).count() == 0 and pii.redacted(docs(spark, [])).count() == 0


def counts(text):
    text = text or ""
    w = BLANK.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            repeated += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def plain_quality(rows):
    """The verdicts by sorted values in place of sketches."""
    stats = [(i, *counts(t), lang, source, t) for i, t, lang, source in rows]
    groups = collections.defaultdict(list)

    def rounded(v):
        drop = max(v.bit_length() - 7, 0)
        return v >> drop << drop

    def metrics(s):
        lines = sum(bool(BLANK.search(x)) for x in (s[8] or "").split("\n"))
        return {"symbols": 1000 * s[3] // max(s[2], 1), "word_length": 100 * s[2] // max(s[1], 1), "repeated_lines": 1000 * s[4] // max(lines, 1)}

    failed = [s[1] < 10 or 100 * s[5] > 20 * s[1] for s in stats]
    for s, f in zip(stats, failed, strict=True):
        if not f:
            for key in ((s[6], s[7]), (s[6],), ()):
                groups[key].append(metrics(s))
    out = []
    for s, f in zip(stats, failed, strict=True):
        level, group = next(((n, groups[k]) for n, k in (("source", (s[6], s[7])), ("language", (s[6],))) if len(groups[k]) >= 50), ("all", groups[()]))
        level = level if groups[(s[6], s[7])] else None
        good = not f

        def place(name, percent, group=group):
            """The sketch's place of a percentile, and the last value of that place."""
            values = sorted(rounded(m[name]) for m in group)
            v = values[-(-percent * len(values) // 100) - 1]
            return v, v + (1 << max(v.bit_length() - 7, 0)) - 1

        if good:
            m = metrics(s)
            (low, _), (mid, mid_end), (_, high_end) = (place("word_length", p) for p in (25, 50, 75))
            reach = 10 * (high_end - low)
            good = m["symbols"] <= place("symbols", 97)[1] and m["repeated_lines"] <= place("repeated_lines", 99)[1] and mid - reach <= m["word_length"] <= mid_end + reach
        out.append((s[0], *s[1:6], f, good, level))
    return out


def test_quality_agrees_with_sorted_values(spark):
    rows = []
    for i in range(500):
        lang, source = ("en", "de", None)[i % 3], ("a", "b", None, "rare")[min(i % 7, 3) if i > 20 else 3]
        text = " ".join(f"word{(i * k) % 97}x" + ("#$%" if i % 11 == 0 else "") for k in range(5 + i % 60))
        if i % 13 == 0:
            text = "\n".join(["the same line again and again"] * 6 + [text])
        rows.append((i, text, lang, source))
    rows += [(i, t, "en", "a") for i, t in ODD]
    key = lambda r: tuple((x is None, x) for x in r)
    out = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "sketch")) for r in quality(docs(spark, rows, extra=True)).collect()]
    assert sorted(out, key=key) == sorted(plain_quality(rows), key=key)


def test_fences_follow_their_groups(spark):
    """Two sources of one language with other habits have other fences, and none is a constant."""
    rows = [(i, " ".join(f"{'long' * (1 + i % 3) if i % 2 else 'ab'}{k}x" + "#" * (k < i % 9 * (i % 2)) for k in range(40)), "en", "b" if i % 2 else "a") for i in range(400)]
    fences = {r.g_source: r for r in fenced(sketches(text_stats(docs(spark, rows)).selectExpr("*", "false as base_failed"))).collect()}
    assert fences["a"].symbols_high == 0 < fences["b"].symbols_high
    assert fences["a"].word_length_high < fences["b"].word_length_low or fences["a"].word_length_high != fences["b"].word_length_high
    assert {r.sketch for r in fences.values()} == {"source"}


def test_quality_empty_table(spark):
    assert quality(docs(spark, [])).count() == 0


def test_sharding(spark):
    rows = ODD + [(100 + i, f"text {i % 5}") for i in range(500)]
    out = sharded(docs(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    left = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    left.subtract((r.doc_id, r["size"], r.text_crc32) for r in out)
    assert not any(left.values())
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 8
    assert {r.doc_id: r.shard for r in out} == {r.doc_id: r.shard for r in sharded(docs(spark, rows[::-1])).collect()}
    assert sharded(docs(spark, [])).count() == 0


def test_shares_follow_weights(spark):
    out = sharded(docs(spark, [(i, "") for i in range(4000)]), [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in out}[1] / 4000 - 0.75) < 0.03


def test_numbers_of_a_hot_group_are_gapless(spark):
    df = spark.range(50_000).selectExpr("id", "if(id % 3 = 0, 'rare', null) as g")
    out = numbered(df, "g", "id", "n").groupBy("g").agg({"n": "max", "*": "count"}).collect()
    assert all(r["max(n)"] == r["count(1)"] - 1 for r in out)


def test_a_period_stays_within_one_block_of_its_weights():
    for weights in ({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.5, **{f"s{i}": 0.01 for i in range(50)}}, {"a": 7.3, "b": 2.1, "c": 0.4, "d": 0.001}):
        slots = shares(weights, 512)
        assert sum(slots.values()) == 512
        done = collections.Counter()
        for t, k in enumerate(one_period(slots), 1):
            done[k] += 1
            assert all(abs(done[x] * 512 - t * slots[x]) < 512 for x in slots)
        assert dict(done) == slots


def test_a_schedule_places_every_block_once():
    blocks = {"a": 1000, "b": 37, "c": 3, "d": 0}
    used, taken = set(), collections.Counter()
    for k, first, last, start, period, places in schedule(blocks, {"a": 1.0, "b": 2.0, "c": 2.0}, 64):
        for i in range(last - first + 1):
            used.add(start + i // len(places) * period + places[i % len(places)])
            taken[k] += 1
    assert used == set(range(1040)) and taken == {"a": 1000, "b": 37, "c": 3}


def test_a_long_run_stays_within_one_block_of_the_true_weights():
    for n, blocks in ((20, 1500), (256, 60)):
        weights = {f"src{i}": 1.0 for i in range(n)} | {"src0": 3.0, "src1": 2.0}
        # Long decimals have no short period: the slots are listed.
        for own in (weights, weights | {"src0": 3.1415926535}):
            total, at = sum(own.values()), {}
            for k, first, last, start, period, places in schedule(dict.fromkeys(own, blocks), own):
                at |= {start + i // len(places) * period + places[i % len(places)]: k for i in range(last - first + 1)}
            assert sorted(at) == list(range(n * blocks))
            done = collections.Counter()
            for t in range(n * blocks):
                done[at[t]] += 1
                if done["src0"] == blocks:
                    break
                assert all(abs(done[k] - (t + 1) * own[k] / total) < 1 + 1e-6 for k in ("src0", "src1", "src2", f"src{n - 1}"))


def test_each_of_many_sources_has_its_own_weight(spark):
    rows = [(i, "", "en", f"s{i % 300:03d}") for i in range(1200)]
    out = mixed(docs(spark, rows), {"s299": 4.0, "s000": 0.0}, block_rows=1).collect()
    assert sorted(r.mix_position for r in out) == list(range(1200))
    # Shares: 298 of 1 and one of 4; the source of weight 0 waits for all others.
    early = collections.Counter(r.source for r in out if r.mix_slot < 302)
    assert early == {f"s{i:03d}": 1 for i in range(1, 299)} | {"s299": 4}
    assert {r.source for r in out if r.mix_slot >= 1196} == {"s000"}


def test_mixing(spark):
    rows = [(i, str(i), "en", "abcd"[min(i % 10, 3)]) for i in range(1000)] + [(i, t, "en", None) for i, t in ODD]
    df = docs(spark, rows, extra=True)
    out = mixed(df, {"d": 2.0}, block_rows=4)
    got = out.collect()
    assert out.columns == [*df.columns, "mix_block", "mix_slot", "mix_position"]
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    assert {r.mix_slot for r in got} == set(range(max(r.mix_slot for r in got) + 1))
    early = collections.Counter(r.source for r in got if r.mix_slot < 18)
    # Six shares, two of them for d: 6 of 18 slots, give or take one, and 3 for each other source.
    assert 4 * 5 <= early["d"] <= 4 * 7 and all(4 * 2 <= early[k] <= 4 * 4 for k in "abc")
    assert mixed(docs(spark, [])).count() == 0


CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\n</turn>\n### user:\n\\\\<#"), (1, 5, "assistant", ""), (2, 0, "a%0A\n:b", None), (2, 1, None, "x\\"), (None, 0, "assistant", "né😀"),
        (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "user", "tie a"), (4, 0, "assistant", "long " * 50_000), *((5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)),
    ]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "'z' as tree", "'z' as node")
    out = {r.tree: r for r in digests(formatted(chain(df))).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = out[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digests(formatted(chain(spark.createDataFrame([], CONV)))).count() == 0


def test_branches_are_ranked_by_score(spark):
    tree = [(1, 0, None, 0.0), (1, 1, 0, 1.0), (1, 2, 0, 2.0), (1, 3, 1, 5.0), (1, 4, 2, 3.0), (1, 5, 2, 4.0), (1, 9, 77, 1.0)]
    df = spark.createDataFrame([(*r, "user", f"n{r[1]}") for r in tree], "tree long, node long, parent long, score double, role string, text string")
    out = sorted((r["rank"], r.leaf, re.findall("n[0-9]", r.conversation)) for r in formatted(df, top=3).collect())
    assert out == [(1, 3, ["n0", "n1", "n3"]), (2, 5, ["n0", "n2", "n5"]), (3, 4, ["n0", "n2", "n4"])]
