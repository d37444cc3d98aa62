"""The queries of operators 1, 7, 8 and 10 against plain versions, on small tables with all defined cases."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from odd import ITEM_WORDS, SCHEMA, WORDS, documents, lowered, passages, save, sha

from paperflow.llm import quality_rules
from paperflow.llm.queries import queries


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_decontamination(spark, tmp_path):
    docs = documents()
    items = [(k, " ".join(p[:40])) for k, p in enumerate(passages())] + [(50, None), (51, ""), (52, "One"), (53, "w1 W2"), (0, " ".join(passages()[3][5:30])), (None, "one")]
    folder = save(spark, tmp_path, documents=(docs, SCHEMA), benchmark=(items, "item_id long, text string"))
    got = rows(queries()["op1_decontamination"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    want = Counter()
    for doc_id, text, *_ in docs:
        words = ITEM_WORDS.findall(lowered(text))
        hit, found = set(), set()
        for item, body in items:
            line = ITEM_WORDS.findall(lowered(body))
            k = min(13, len(line))
            if item is None or not line:
                continue
            windows = {tuple(line[i : i + k]) for i in range(len(line) - k + 1)}
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(str(item))
        want[(doc_id, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words))] += 1
    assert got == want


def test_decontamination_in_blocks_and_empty(spark):
    from paperflow.llm import decontamination

    docs = spark.createDataFrame(documents(), SCHEMA)
    items = spark.createDataFrame([(k, " ".join(p[:60])) for k, p in enumerate(passages())], "item_id long, text string")
    whole, blocked = decontamination.digest(docs, items), decontamination.digest(docs, items, block_bytes=700)
    assert rows(whole) == rows(blocked)
    assert decontamination.decontaminate(docs, items).columns == docs.columns
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontamination.digest(docs.limit(0), items).collect() == []


def test_longest_matches(spark):
    from paperflow.llm import decontamination

    line = [f"t{k}" for k in range(50)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(line[5:35]) + " c " + " ".join(line[:13]))], "doc_id long, text string")
    df, into = decontamination.scan(docs, spark.createDataFrame([(9, " ".join(line))], "item_id long, text string"), matches=True)
    got = sorted(tuple(m) for m in df.first()[into]["matches"])
    assert got == [("9", 0, 33, 13), ("9", 5, 2, 30)]


def test_warc(spark, tmp_path):
    pages = [(k, f"http://h/{k}", "<p>été" + "x" * (k % 7) * 3000) for k in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", None), (5, "http://h/5", "<p>été" + "x" * 15000), (7, "http://other", "different"), (103, "v", "WARC/1.1\r\n\r\n" * 3)]
    folder = save(spark, tmp_path, pages=(pages, "page_id long, url string, html string"))
    got = rows(queries()["op7_warc"](spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    least = {}
    for page, _, html in pages:
        least[html or ""] = min(least.get(html or "", page), page)
    want = Counter()
    for page, _, html in pages:
        raw, first = (html or "").encode(), least[html or ""]
        want[(page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == first else "revisit", None if page == first else first)] += 1
    assert got == want


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_warc_ranges_own_each_record_once(spark, tmp_path, split):
    from paperflow.llm import warc

    pages = spark.createDataFrame([(k, "u", f"page {k} " * (k * 17 % 90)) for k in range(40)], "page_id long, url string, html string").coalesce(2)
    files = [(r["file"], r["bytes"]) for r in warc.write(pages, f"file://{tmp_path}/a").collect()]
    for file, size in files:  # junk between, before and after members
        with open(file.removeprefix("file://"), "rb") as f:
            data = f.read()
        with open(file.removeprefix("file://"), "wb") as f:
            f.write(b"\x1f\x8b\x08junk" + data + b"\x1f\x8b\x08\x00\x00")
    found = warc.read(spark, [(f, n + 12) for f, n in files], split_bytes=split).collect()
    assert sorted(r["payload"].decode() for r in found if r["record_type"] == "response") == sorted({f"page {k} " * (k * 17 % 90) for k in range(40)})
    assert len(found) == 40


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, rx) in enumerate(PATTERNS.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


PRIVATE = [
    "mail a.b+c@x-y.co.uk, a@b.c.d@e.f and a@b.cd+e@f.gh; A@b no@ @no.x",
    "😀 host 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 256.1.1.1 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111x 12 34  5500005555555559",
    "call +1 (415) 555-0100, +44 20 7946 0958. +1 2 +123456789012345678 ++49 30 1234567 é",
    "a" * 3000 + "@" + "b." * 3000 + "c",
    "1 " * 2000,
    "1." * 3000 + "1",
    "+1" + "-" * 3000,
]


def test_pii(spark, tmp_path):
    secret = [(200 + k, f"zebra{'abcdefgh'[k]} writes to Quokka under boss@corp.example today {'lorem ipsum'[k:]}", "en", "s", 0, "") for k in range(6)]
    docs = documents() + [(100 + k, t, "en", "s", 0, "") for k, t in enumerate(PRIVATE)] + secret + [(300, "no quokka here", "en", "s", 0, "")]
    folder = save(spark, tmp_path, documents=(docs, SCHEMA))
    got = queries()["op8_pii"](spark, folder).collect()
    want = Counter()
    for doc_id, text, *_ in docs:
        spans = plain_spans(text)
        n = Counter(s[3] for s in spans)
        want[(doc_id, *(n[k] for k in PATTERNS), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    spans = {r["doc_id"]: r["spans"].split(",") for r in got}
    for doc_id, text, *_ in docs:
        assert {f"{k}:{a}:{b}" for a, _, b, k in plain_spans(text)} <= set(spans[doc_id]) | {""}
    for doc_id, text, *_ in secret:
        at = text.index("Quokka")
        assert f"term:{at}:{at + 6}" in spans[doc_id]
    assert spans[300] == [""]


def test_pii_sanitised(spark):
    from paperflow.llm import pii

    docs = spark.createDataFrame([(1, "to a@b.cd or +1 415 555 0100!"), (2, None), (3, "plain")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()} == {1: "to [EMAIL] or [PHONE]!", 2: "", 3: "plain"}
    assert pii.digest(docs.limit(0)).collect() == []


def plain_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    twice = {p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), len(lines)


VALUES = {"symbols": lambda s: s[2] / max(s[1], 1), "duplicate_lines": lambda s: s[3] / max(s[5], 1), "repeated_words": lambda s: s[4] / max(s[0], 1), "long_words": lambda s: s[1] / max(s[0], 1), "few_words": lambda s: 1 / max(s[0], 1)}


def base_fails(s):
    return s[0] < 10 or 100 * s[4] > 20 * s[0]


def plain_cutoffs(stats, good, permitted=0.05, delta=0.05):
    """{stratum: {rule: cutoff}} for (id, stratum, statistics) of labelled good documents."""

    def tuning(i):
        return hashlib.md5(str(i).encode()).hexdigest()[0] < "8"

    known = {(i, lang, s) for i, lang, s in stats if i in good}
    held = Counter(lang for i, lang, _ in known if not tuning(i))
    least = math.ceil(math.log(delta / (len(held) + 1)) / math.log1p(-permitted))
    pooled = {lang for _, lang, _ in stats if held[lang] < least}
    tested, out = len({lang for _, lang, _ in stats} - pooled) + 1, {}
    for name in {("pool",) if lang in pooled else (lang, 1) for _, lang, _ in stats}:
        mine = [(i, s) for i, lang, s in known if (("pool",) if lang in pooled else (lang, 1)) == name]
        tune, proof = [s for i, s in mine if tuning(i) and not base_fails(s)], [s for i, s in mine if not tuning(i)]
        if not tune or not proof:
            continue
        at = {}
        for rule, (_, cuts) in quality_rules.RULES.items():
            at[rule] = next((k for k, c in enumerate(cuts) if sum(VALUES[rule](s) > c for s in tune) <= permitted / 5 * len(tune)), len(cuts))
        chosen = {}
        for relaxed in range(8, -1, -1):
            cut = {r: (*quality_rules.RULES[r][1], *[math.inf] * 20)[at[r] + relaxed] for r in at}
            k, n = sum(base_fails(s) or any(VALUES[r](s) > c for r, c in cut.items()) for s in proof), len(proof)
            if sum(math.comb(n, j) * permitted**j * (1 - permitted) ** (n - j) for j in range(k + 1)) > delta / tested:
                break
            chosen = cut
        out |= {lang: chosen for lang in {x for _, x, _ in stats} if (("pool",) if lang in pooled else (lang, 1)) == name}
    return out


def test_quality_rules(spark, tmp_path):
    docs = documents() + [(400 + k, f"good text number {k} " + " ".join(f"g{k}x{j}" for j in range(k % 40 + 8)) + (" #" * 12 if k % 50 == 0 else ""), "en", "s", 0, "") for k in range(700)]
    docs += [(2000 + k, f"guter text {k} " + " ".join(f"wort{k}x{j}" for j in range(k % 30 + 9)), ("de", "fr", None)[k % 3], "s", 0, "") for k in range(330)]
    docs += [(1200, "a b c d e " * 4 + "z" * 10 + " " + " ".join(f"q{k}" for k in range(100)), "en", "s", 0, ""), (1201, "### " * 6 + " ".join(f"h{k}" for k in range(60)), "en", "s", 0, ""), (1202, "$$$ " * 9 + " ".join(f"h{k}" for k in range(60)), "de", "s", 0, "")]
    labels = [(d[0], 1 if 400 <= (d[0] or 0) < 1200 or (d[0] or 0) >= 2000 else 0, 0) for d in docs] + [(3, None, 0), (401, 1, 0)]
    folder = save(spark, tmp_path, documents=(docs, SCHEMA), labels=(labels, "doc_id long, quality int, toxic int"))
    got = rows(queries()["op10_quality_rules"](spark, folder))
    stats = [(d[0], d[2], plain_quality(d[1])) for d in docs]
    cut = plain_cutoffs(stats, {i for i, q, _ in labels if q == 1} - {i for i, q, _ in labels if q == 0})
    assert cut["en"] and cut["de"] and cut["de"] == cut["fr"] == cut[None] != cut["en"]
    want = Counter()
    for i, lang, s in stats:
        kept = not base_fails(s) and not any(VALUES[n](s) > c for n, c in cut.get(lang, {}).items())
        want[(i, *s[:5], base_fails(s), kept)] += 1
    assert got == want
    assert [r for r in got if r[0] == 1202][0][7] is False
    assert [r for r in got if r[0] == 1201][0][7] is False
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
