"""Operators 11 to 13 against brute force, and edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import conversation_repair, queries, secret_scan, source_audit
from scoreloom.llm.shared import materialize

from .test_operators import EDGES, table

# 11 ---------------------------------------------------------------------------------------------


def cheapest(codes):
    """Cost and least audit, by Dijkstra's search over (cost, audit)."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(codes) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, {0: 2, 1: 2, 2: 3, 3: 2}[state]))
        if i < len(codes):
            fault, initial = codes[i] >> 2, "sua?"[codes[i] & 3]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            for own, c, to in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)):
                if own == state and fault not in (1, 2):
                    more = 3 * (fault == 3)
                    if c == initial:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                    if c != "s":
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to))


def test_walks_are_the_least_of_the_cheapest():
    r = random.Random(0)
    for _ in range(1500):
        codes = bytes(r.choice([0, 1, 2, 3, 1, 2, 1, 2, 4, 5, 9, 10, 12, 13, 14]) for _ in range(r.randrange(14)))
        audit = cheapest(codes)[1]
        assert conversation_repair.walk(codes, conversation_repair.END, 0, True)[0].decode() == audit
        left, right = codes[: (cut := r.randrange(len(codes) + 1))], codes[cut:]
        m = conversation_repair.matrix(right)
        behind = tuple(min(m[4 * s + t] + conversation_repair.END[t] for t in range(4)) for s in range(4))
        one, state = conversation_repair.walk(left, behind, 0, False)
        assert (one + conversation_repair.walk(right, conversation_repair.END, state, True)[0]).decode() == audit


def brute_repair(rows):
    """Of original ``(turn, role, text)`` with its conversation: the contract's columns."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    codes, seen, counts = [], set(), Counter()
    for _, role, text in kept:
        tail = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = 1 if not tail else 2 if (role, text) in seen else 3 if tail not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        codes.append(fault * 4 + ("sua".find(role[:1]) % 4 if role[:1] else 3))
    turns = [t for t, _, _ in kept if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    cost, audit = cheapest(codes)
    out, i, state = [], 0, 0
    for letter in audit:
        need = "assistant" if state == 2 else "user"
        if letter == "I":
            out.append(f"{need}:")
        else:
            role, text = kept[i][1:]
            i += 1
            if letter == "D":
                continue
            out.append(f"{need if letter == 'R' else role}:{text}")
        state = {"assistant": 3, "user": 2}[need] if letter in "IR" else 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


SAYINGS = ["Yes.", "No!", "Why?", "no end", "", " \n\t", "Yes. ", None, "日本。", "x.\x0b", " "]


def conversations(seed, sizes):
    r = random.Random(seed)
    rows = []
    for conv, n in sizes:
        rows += [(conv, r.choice([None, *range(n)]) if r.random() < 0.1 else t * (1 + (r.random() < 0.05)), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]), r.choice(SAYINGS) if r.random() < 0.7 else f"t{t}.") for t in range(n)]
    return rows


def test_repair_equals_brute_force(spark):
    # One conversation holds most turns, so it lies in several partitions, and one of them may be all its own.
    rows = conversations(1, [(c, 1 + c % 9) for c in range(60)] + [(None, 7), (-3, 4), (100, 400), (101, 3)])
    turns = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, place string, part int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = materialize(conversation_repair.repair(conversation_repair.damaged(turns)), "log")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert log.where("conv_id = 100").select(conversation_repair._part()).distinct().count() > 1
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_digest(log, turns).collect()}
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    assert got == {c: brute_repair(own[c]) for c in own}


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conversation_repair.repair_digest(conversation_repair.repair(empty), empty).count() == 0
    # Nothing is left of this one after damage, and the other is one very long turn.
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(*gone, "user", "Yes."), (2000, 1, "user", "long " * 400_000 + ".")]
    turns = spark.createDataFrame(rows, schema)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_digest(conversation_repair.repair(conversation_repair.damaged(turns)), turns).collect()}
    assert got[gone[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2000] == brute_repair([rows[1]])


# 12 ---------------------------------------------------------------------------------------------


def brute_audit(rows, min_docs, top):
    """``rows``: (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (own[t] + 5) // (sum(own.values()) + 5 * len(kept)) for t in kept} for s, own in n.items()}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            out |= {(lang, s, "pair", x[2], -x[0], i) for i, x in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", x[2], -x[0], i) for i, x in enumerate(sorted(term)[:top], 1)}
    return out


def audit_rows(seed, n):
    r = random.Random(seed)
    words = ["The", "the,", "thé", "THE.", "a-b", "A_b", "x1y", "日本", "日本,語", "ÄÖ", "äö", "z z", "(end)", "end", "of;of", "`", "...", "ſ", "K\x1cL"]
    space = [" ", "\n", "\t ", "\x0b", "  ", "\r\n"]
    rows = [("".join(r.choice(words) + r.choice(space) for _ in range(r.randrange(30))), r.choice(["en", "de", "", None]), r.choice(["s1", "s2", "é", "", None, "S1"])) for _ in range(n)]
    return [*rows, *rows[:20], (None, "en", "only"), ("", "fr", "one"), (" \n", "fr", "two"), ("long" * 100_000 + " the", "en", "s1")]


@pytest.mark.parametrize("cells", [source_audit.CELLS, 64])
def test_audit_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(source_audit, "SMALL_ROWS", cells)
    rows = audit_rows(3, 300)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, chunk string, block int").repartition(3)
    got = source_audit.divergence(docs, min_docs=5, top=6).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_audit(rows, 5, 6)


def test_audit_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert source_audit.divergence(spark.createDataFrame([], schema)).count() == 0
    # No term is kept: sources differ by nothing.
    few = spark.createDataFrame([(1, "a b", "en", "s1"), (2, None, "en", None)], schema)
    assert {tuple(r) for r in source_audit.divergence(few).collect()} == {("en", "s1", "pair", "", 0, 1), ("en", "", "pair", "s1", 0, 1)}


def test_share_is_exact_beyond_64_bits(spark):
    n = 10**12 + 7
    row = spark.range(1).select(source_audit.share(F.lit(n), F.lit(3 * n), F.lit(10**6))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (3 * n + 5 * 10**6)


# 13 ---------------------------------------------------------------------------------------------

PATTERNS = {
    "assign": (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[1]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    "hub": (re.compile("gh[oprsu]_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 40),
    "chat": (re.compile("xox[abprs]-(?:[0-9]+-)+[A-Za-z0-9]+"), lambda m: len(m[0]) >= 24),
    "pem": (re.compile("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True),
}


def brute_secrets(text):
    found = [(k, m.start(), m.end()) for k, (p, ok) in PATTERNS.items() for m in p.finditer(text) if ok(m)]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0]), s[2]))


def test_scanner_equals_patterns(monkeypatch):
    r = random.Random(1)
    parts = ["password", "TOKEN", "secret", "passwd", "api_key", "ApiKey", " ", "=", ":", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789ab", "é", "日", "😀", "\n", "abc", "xyz.", "/+", "a", "F", " = ", "ghp_", "Z" * 36, "xoxb-", "123456-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(6000)]
    want = [brute_secrets(t) for t in texts]
    assert {k for w in want for k, _, _ in w} == set(PATTERNS)
    scan = secret_scan.scanner()
    assert scan.find(texts) == want
    monkeypatch.setattr(secret_scan, "LANE", 16)
    assert scan.find(texts[:800]) == want[:800]
    # A match that is dropped takes up what it covers.
    assert scan.find(["secret=token: abcdefgh"]) == [[]]


def test_scanner_takes_other_rules():
    rules = (secret_scan.Rule("ab", "a(b|cd)*e?"), secret_scan.Rule("two", "[x-z]{2,3}", least=3), secret_scan.Rule("not", "q[^a-p\\x20-\\x2f\\x80-\\xff]+"))
    r = random.Random(2)
    texts = ["".join(r.choice("abcdexyzq! ") for _ in range(r.randrange(30))) for _ in range(2000)]
    patterns = {"ab": "a(?:b|cd)*e?", "two": "[x-z]{2,3}", "not": "q[^a-p\\x20-\\x2f\\x80-\\xff]+"}
    want = [sorted(((k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if k != "two" or m.end() - m.start() == 3), key=lambda s: (s[1], list(patterns).index(s[0]))) for t in texts]
    assert secret_scan.Scanner(rules).find(texts) == want
    with pytest.raises(ValueError):
        secret_scan.Scanner((secret_scan.Rule("all", "[\\x00-\\xff]+"),))


def test_secret_edges(spark):
    long = "x " * 300_000 + "token = abcdef0123456789abcdef012345"
    rows = [*EDGES, (9, long, "en"), (10, "f0" * 100_000, "en"), (11, "é password:'hunter2hunter2'", None)]
    got = secret_scan.secret_digest(secret_scan.find_secrets(table(spark, rows))).collect()
    own = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = [(i, found := brute_secrets(t or ""), [s for s in found if s[0] in secret_scan.BASE]) for i, t, _ in rows]
    assert Counter(map(tuple, got)) == Counter((i, *(sum(s[0] == k for s in base) for k in secret_scan.BASE), hashlib.sha256(own(base).encode()).hexdigest(), own(found)) for i, found, base in want)
    assert secret_scan.secret_digest(secret_scan.find_secrets(table(spark, []))).count() == 0


def test_queries_run_on_small_folders(spark, tmp_path):
    rows = audit_rows(4, 80)
    spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turns = conversations(2, [(c, 6) for c in range(12)])
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in queries.op12_source_divergence(spark, str(tmp_path)).collect()} == brute_audit(rows, 30, 50)
    assert {tuple(r)[1:4] for r in queries.op13_secret_scan(spark, str(tmp_path)).collect()} == {(0, 0, 0)}
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: brute_repair([t for t in turns if t[0] == c]) for c in range(12)}
