"""Source divergence, license scan and spelling variants against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import cache
from zlib import crc32

import numpy as np
import pytest
from re import _parser

from ledgerflow.llm import divergence, licenses, urls, variants

SCHEMA = "doc_id long, text string, lang string, source string, term string, word string, row long, n long, value long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, "x", "x", 1, 1, 1) for i, t, lang, s in rows], SCHEMA)


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))) for _, t, lang, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen, whole, by = Counter(), Counter(), defaultdict(Counter)
        for _, s, words in mine:
            seen.update(set(words))
            whole.update(words)
            by[s].update(words)
        kept = [w for w in seen if seen[w] >= min_docs]

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in p:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if by[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,cells", [(200_000, 4_000_000), (5, 3)])
def test_divergence_equals_plain(spark, monkeypatch, block, cells):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice(["Alpha", "béta", "gamma", "x", "日本", "ΩMEGA", "tau", "mu"])[: rng.randint(1, 9)] + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", "-", "1"]).join(words), rng.choice(["en", "en", "en", None]), rng.choice(["a", "a", "b", "é", None])))
    rows += [(7, None, "en", "silent"), (8, "", "lone", "s"), (8, "", "lone", "t"), (None, "tau " * 5000, "en", "a"), rows[0], rows[0]]
    audit = divergence.SourceDivergence(min_docs=3, top=2)
    got = sorted(tuple(r) for r in audit.audit(frame(spark, rows)).collect())
    assert got == plain_audit(rows, 3, 2)
    assert audit.audit(frame(spark, rows).limit(0)).collect() == []


def test_joint_tables_count_terms(spark):
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([("x y z z", "a"), ("x y z", "b"), ("x x y", "c")])]
    audit = divergence.SourceDivergence(min_docs=1)
    tables = audit.joint_tables(frame(spark, rows)).collect()
    both = Counter()
    for r in tables:
        both[r.a, r.b] += r.n
    assert both == {("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 2}
    cells = {(r.p, r.q): r.n for r in tables if (r.a, r.b) == ("a", "b")}
    share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 6)
    assert cells == {(share(1, 4), share(1, 3)): 2, (share(2, 4), share(1, 3)): 1}


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, "one two three " + str(i % 3) * 3 + "abc", "en", "s") for i in range(20)]
    want = sorted(map(tuple, divergence.SourceDivergence().audit(frame(spark, rows)).collect()))
    monkeypatch.setattr(divergence, "ENTRIES", 2)
    assert sorted(map(tuple, divergence.SourceDivergence().audit(frame(spark, rows)).collect())) == want


def sample(pattern, rng):
    """A random text that the pattern matches."""

    def of(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = rng.choice(arg)
                out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
            elif name == "BRANCH":
                out += of(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += of(arg[3])
            elif name == "MAX_REPEAT":
                low, high, part = arg
                out += "".join(of(part) for _ in range(rng.randint(low, min(int(high), low + 2))))
            else:
                raise ValueError(name)
        return out

    return of(_parser.parse(pattern))


@cache
def compiled(pattern):
    return re.compile(pattern)


def plain_scan(scan, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spaced = " " + "  ".join(words) + " "
    found = sorted((m.start(), -m.end(), k) for k, r in enumerate(scan.rules) for m in compiled(r.spaced).finditer(spaced))
    outer, reach = [], -1
    for start, end, k in found:
        if -end > reach:
            outer.append((start, -end, k))
        reach = max(reach, -end)
    stay = []
    for i, (start, end, k) in enumerate(outer):
        before, after = outer[i - 1] if i else None, outer[i + 1] if i + 1 < len(outer) else None
        if not (before and before[1] > start and before[2] < k) and not (after and after[0] < end and after[2] < k):
            stay.append(scan.rules[k])
    at = [i for i, _ in base]
    own = {label for _, label in base}
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {r.label for r in stay})), max((licenses._FORMS[r.form] for r in stay), default=0.0)


def test_licenses_equal_plain(spark):
    rng, scan = random.Random(8), licenses.LicenseScan()
    texts = [sample(r.pattern.replace(" ?", "( )?"), rng) for r in scan.rules]
    texts = [rng.choice(["", "Zürich ", "the "]) + (t if rng.random() < 0.5 else t.upper()).replace(" ", rng.choice([" ", "-", ", ", "\n", "_"])) + rng.choice(["", ".", " or so"]) for t in texts]
    texts += [" and ".join(rng.sample(texts, 4)) for _ in range(150)]
    texts += [None, "", " ", "MIT License", "mit-license MIT license, x mit license", "mitlicense", "émit license", "the license of mit", "Apache License", "GNU General Public License, version 3 or later", "word " * 50_000 + "mit license", "mit license " * 20_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "x", None, None)]
    got = scan.scan(frame(spark, rows)).collect()
    want = sorted(((i, *plain_scan(scan, t)) for i, t, _, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert all(r.label in labels.split(",") for r, (*_, labels, _) in zip(scan.rules, (plain_scan(scan, t) for t in texts)) if r.form == "tag")
    assert scan.scan(frame(spark, rows).limit(0)).collect() == []


def test_license_places(spark):
    scan = licenses.LicenseScan()
    found = scan.detections(frame(spark, [(1, "Licensed under the Apache License, Version 2.0.", "en", "s"), (2, "MIT License or CC BY-NC 4.0", "en", "s")])).collect()
    assert sorted((r.doc_id, r.label, r.form) for r in found) == [(1, "apache-2.0", "notice"), (2, "cc-by-nc-4.0", "short"), (2, "mit", "name")]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for i, t, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(links[w], key=lambda v: (-n[v], v)) for w in n if links[w]}
    form = {w: v for w, v in form.items() if n[v] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("group,pack,states", [(4096, 1024, 1 << 18), (3, 8, 4), (8, 1, 1)])
def test_variants_equal_plain(spark, monkeypatch, group, pack, states):
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "PACK", pack)
    monkeypatch.setattr(variants, "STATES", states)
    rng = random.Random(6)
    stems = ["Garden", "gardens", "École-", "élèves", "window", "abcabc", "aaaaaa", "straße"]
    words = []
    for _ in range(90):
        w = list(rng.choice(stems) + rng.choice(["", "ab", "ing"]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["a"], ["é", w[k]]])
        words += ["".join(w)] * rng.choice([5, 6, 30, 200])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]), "en", "s") for i in range(40)]
    rows += [(50, None, "en", "s"), (51, "", "en", "s"), (None, "garden " * 30, "en", "s"), rows[0], (52, ("q" * 3000 + " ") * 6 + ("q" * 2999 + "z ") * 5, "en", "s")]
    got = variants.SpellingVariants().variants(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == plain_variants(rows)
    assert variants.SpellingVariants().variants(frame(spark, rows).limit(0)).collect() == []


def test_forms_are_followed_to_their_end(spark):
    words = [("abcdef" + "x" * k, 5**k) for k in range(1, 8)]
    links = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(words, words[1:])], "word string, root string")
    assert {r.word: r.root for r in variants.SpellingVariants().roots(links).collect()} == {w: words[-1][0] for w, _ in words[:-1]}


def test_first_differences_split_the_pairs():
    rng = random.Random(1)
    for c in (6, 7):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([c, c + 1]))) for _ in range(200)})
        group = np.array([rng.randint(0, 2) for _ in words])
        whole = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if group[i] == group[j] and min(len(a), len(b)) == c and near(a, b))
        parts = [variants.near_pairs(words, group, c, lo, hi) for lo, hi in ((0, 2), (2, 3), (3, c))]
        assert sorted(p for a, b in parts for p in zip(a.tolist(), b.tolist())) == whole


def test_long_hosts_and_a_model_that_blocks(spark):
    """A host of 20,000 letters beside a word as long in a page; and hosts without a rule that are like blocked ones."""
    rng, long = random.Random(4), "ab" * 10_000
    pages = [(i, f"http://{w}shop{i}.com/de/{w}/offer", f"<p>{w} shop offer {'x' * rng.randint(1, 9)}</p>") for i, w in enumerate(["cheap", "pills", "bets"] * 20)]
    pages += [(100 + i, f"http://{w}river{i}.org/{w}", f"<p>{w} river garden</p>") for i, w in enumerate(["calm", "green", "deep"] * 20)]
    pages += [(200, "http://cheappills.net/offer", ""), (201, "http://greenriver.net/garden", ""), (202, f"http://{long}.net/", f"<b>{long}</b>"), (203, f"http://{long}cheap.net/", None)]
    got = {r.page_id: r.verdict for r in urls.HostModel().judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and (got[0], got[100]) == ("block", "allow")
    assert (got[200], got[201]) == ("block", "allow")
