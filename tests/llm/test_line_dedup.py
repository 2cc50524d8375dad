from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from chainlens.llm import line_dedup
from chainlens.llm.line_dedup import band_keys, dedup_lines, linked_in_cell

K = line_dedup.SHINGLE


def shingles(line):
    return {line[k : k + K] for k in range(max(1, len(line) - K + 1))}


def expected(rows):
    """Rows of equal id and text count once; all-pairs Jaccard over distinct lines."""
    import xxhash

    def order(row):
        digest = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return (row[0] is not None, row[0] or 0, digest - (1 << 64) if digest >> 63 else digest)

    distinct = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=order)
    lines = list(dict.fromkeys(x for _, t in distinct for x in t.split("\n") if x.strip()))
    sets, root = [shingles(x) for x in lines], list(range(len(lines)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    place, seen, out = {x: k for k, x in enumerate(lines)}, set(), {}
    for doc_id, text in distinct:
        keep = []
        for x in text.split("\n"):
            if x.strip():
                if find(place[x]) in seen:
                    continue
                seen.add(find(place[x]))
            keep.append(x)
        out[doc_id, text] = "\n".join(keep)
    return Counter((r[0], r[1], None if r[1] is None else out[r[0], r[1]]) for r in rows)


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_lines(request, rows, frame):
    df = request.getfixturevalue(frame)
    result = dedup_lines(df)
    assert result.columns == [c for c in df.columns if c not in ("kept_text", "n_lines", "n_removed")] + ["kept_text", "n_lines", "n_removed"]
    got = result.collect()
    assert Counter((r.doc_id, r.text, r.kept_text) for r in got) == expected(rows)
    for r in got:
        assert r.n_lines == (0 if r.text is None else r.text.count("\n") + 1)
        assert r.text is None or r.n_lines - r.n_removed == (r.kept_text.count("\n") + 1 if r.n_lines > r.n_removed else 0)


def test_near_lines_and_one_very_common_line(spark):
    rng = random.Random(5)
    base = " ".join(f"word{rng.randrange(10**6)}" for _ in range(30))
    rows = []
    for k in range(60):
        varied = base.replace(base.split()[k % 30], f"other{k}", 1)
        rows.append((k, f"{varied}\na line that all documents have\nown line number {k * 7919} of document {k}{rng.random()}", "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept_text for r in dedup_lines(df).collect()}
    assert {(k, t, got[k]) for k, t, *_ in rows} == set(expected(rows))
    assert got[0].count("\n") == 2 and all("all documents" not in got[k] for k in range(1, 60))


def test_buckets_are_split(monkeypatch, docs, rows):
    monkeypatch.setattr(line_dedup, "CELL", 1)
    got = dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text, r.kept_text) for r in got) == expected(rows)


def test_large_tables_are_joined_by_shuffles(monkeypatch, docs, rows):
    monkeypatch.setattr("chainlens.llm.common.BROADCAST_BYTES", -1)
    got = dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text, r.kept_text) for r in got) == expected(rows)


def test_empty_table(no_docs):
    assert dedup_lines(no_docs).count() == 0


def test_recall_of_the_bands():
    rng = random.Random(2)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 300)))
        at = rng.randrange(len(a))
        b = a[:at] + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 6))) + a[at:]
        both = len(shingles(a) & shingles(b))
        if 0.8 <= both / len(shingles(a) | shingles(b)) <= 0.88:
            pairs.append((a, b))
    keys = band_keys([x for p in pairs for x in p])
    met = (keys[::2] == keys[1::2]).any(axis=1).mean()
    assert met > 0.995
    strangers = band_keys(["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(400)])
    assert len({tuple(k) for k in strangers.tolist()}) == 400 and (strangers[1:] == strangers[:-1]).any(axis=1).mean() < 0.01


def test_cell_links_are_exact():
    rng = random.Random(4)
    base = "".join(rng.choice("abcde ") for _ in range(200))
    texts = list({base[:k] + "Z" * rng.randrange(1, 30) + base[k:] for k in range(0, 200, 5)})
    roots, sets = linked_in_cell(texts), [shingles(t) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    want[a] = want[b] = min(want[a], want[b])
    assert roots == want


def test_lines_of_a_common_key_are_not_paired(monkeypatch, spark):
    monkeypatch.setattr(line_dedup, "CELL", 16)
    rng = random.Random(6)
    base = " ".join(f"word{rng.randrange(10**6)}" for _ in range(30))
    # lines about a template, and a chain that leads away from it
    lines = [f"{base} on day {rng.randrange(10**7):07}" for _ in range(300)]
    chain = base
    for k in range(60):
        at = rng.randrange(len(chain) - 8)
        chain = chain[:at] + "".join(rng.choice("XYZUVW") for _ in range(3)) + chain[at + 3 :]
        lines.append(chain)
    rows = [(k, f"{x}\nline {rng.random()} of its own", "en", "s", 0) for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    cells = line_dedup.candidate_cells(line_dedup.line_table(df, "doc_id", "text"))
    assert cells.count() <= line_dedup.BANDS * 2 * len(rows)
    texts = spark.createDataFrame([(k, x) for k, x in enumerate(dict.fromkeys(lines))], "line long, text string")
    links, rest = line_dedup.led_links(texts.selectExpr("1L as cell", "line"), texts)
    assert links.count() <= line_dedup.LEADERS * line_dedup.ROUNDS * len(rows)
    assert Counter((r.doc_id, r.text, r.kept_text) for r in dedup_lines(df).collect()) == expected(rows)


def test_cells_compared_together_are_exact(monkeypatch):
    rng = random.Random(9)
    letters = ["abc de", "abcdefghij \u0394\u65e5\U0001f600", "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))]
    for met in (50, 1 << 20) * 8:
        monkeypatch.setattr(line_dedup, "COMPARED", met)
        texts, cells = [], []
        for cell in range(8):
            of, own = rng.choice(letters), set()
            bases = ["".join(rng.choice(of) for _ in range(rng.randrange(1, 80))) for _ in range(4)]
            for _ in range(rng.randrange(1, 25)):
                line = rng.choice(bases)
                for _ in range(rng.randrange(4)):
                    at = rng.randrange(len(line) + 1)
                    line = line[:at] + rng.choice(of) + line[at + rng.randrange(2) :]
                own.add(line or "x")
            texts += sorted(own, key=lambda _: rng.random())
            cells += [cell] * len(own)
        sets, want = [shingles(t) for t in texts], list(range(len(texts)))
        for _ in texts:
            before = list(want)
            for a in range(len(texts)):
                for b in range(a):
                    both = len(sets[a] & sets[b])
                    if cells[a] == cells[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                        want[a] = want[b] = min(want[a], want[b])
            if want == before:
                break
        assert line_dedup.linked_lines(texts, np.array(cells)) == want


def test_lines_of_a_template_are_dealt_by_rare_shingles(monkeypatch, spark):
    monkeypatch.setattr(line_dedup, "CELL", 64)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))
    lines = [base + "".join(rng.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(1500)]
    # a near copy of every fifth line
    lines += [x[:100] + "Q" + x[100:] for x in lines[::5]]
    texts = spark.createDataFrame(list(enumerate(lines)), "line long, text string").repartition(3)
    links, rest = line_dedup.led_links(texts.selectExpr("1L as cell", "line"), texts)
    rows = rest.collect()
    # pairs of parts would be 29 rows a line
    assert {r.part for r in rows} == {0} and len(rows) < 4 * len(lines)
    found = line_dedup.verified_links(rest, texts, 0.8).unionByName(links).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found} == {(5 * k, 1500 + k) for k in range(300)}


def test_entries_are_sorted_and_met_once():
    rng = random.Random(10)
    for keys, lines in ((3, 4), (40, 1000), (1 << 64, 1 << 64)):
        pairs = [(rng.randrange(keys), rng.randrange(lines)) for _ in range(300)]
        entries = np.array(pairs + pairs[:50], np.uint64).reshape(-1, 2)
        found, first, ends = line_dedup._distinct(entries)
        # lines are ordered as signed numbers
        want = sorted(set(pairs), key=lambda p: (p[0], p[1] - (p[1] >> 63 << 64)))
        assert [tuple(x) for x in found.tolist()] == want
        met = Counter(k for k, _ in want)
        assert (ends - first).tolist() == [met[k] for k in sorted(met)]


def test_keys_of_a_line_do_not_depend_on_its_neighbours():
    lines = ["a", "abcdefgh", "abcdefghi", "b" * 40, "\U0001f600日" * 9, "c"]
    alone = np.concatenate([band_keys([x]) for x in lines])
    assert (band_keys(lines) == alone).all() and (band_keys(lines[::-1]) == alone[::-1]).all()


def test_names_of_shingles_are_exact_in_few_bits():
    rng = random.Random(11)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x4E00 + n)) for _ in range(60)) for n in (2, 2, 5, 5000, 5000)]
    texts += [texts[3][7:], texts[4][:30] + texts[0][:30]]
    of = [t[k : k + line_dedup.SHINGLE] for t in texts for k in range(len(t) - line_dedup.SHINGLE + 1)]
    for bits in (1, 30, 53):
        line, name = line_dedup._shingle_names(texts, bits)
        assert len(line) == len(name) == len(of) and max(name.tolist()) < 1 << (63 - bits)
        assert len(set(name.tolist())) == len(set(of)) == len(set(zip(name.tolist(), of, strict=True)))


def near_copies(rng, n, length):
    """Distinct lines about one template, most of them alike, and lines cut from it or far from it."""
    base = [f"word{rng.randrange(10**5)}" for _ in range(length)]
    lines = {}
    while len(lines) < n:
        words = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 3, length // 3])):
            words[rng.randrange(length)] = f"other{rng.randrange(10**5)}"
        lines[" ".join(words[: length - rng.choice([0, 0, 0, length // 2])])] = None
    return list(lines)


def linked_classes(links):
    """The smallest member of each linked line's class."""
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def brute_links(texts):
    sets = [shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                yield a, b


def test_near_copies_of_a_cell_meet_where_they_differ(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(line_dedup, "COMPARED", 1 << 40)
    texts = near_copies(random.Random(12), 500, 40)
    tracemalloc.start()
    roots = linked_in_cell(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all shingles that the lines share, met at once, are several hundred MB
    assert peak < 100 << 20
    want = linked_classes(brute_links(texts))
    assert roots == [want.get(k, k) for k in range(len(texts))]


def test_near_copies_above_a_cell_are_dealt_a_few_times(monkeypatch, spark):
    monkeypatch.setattr(line_dedup, "CELL", 64)
    lines = near_copies(random.Random(13), 400, 40)
    texts = spark.createDataFrame(list(enumerate(lines)), "line long, text string").repartition(3)
    links, rest = line_dedup.led_links(texts.selectExpr("7L as cell", "line"), texts)
    assert rest.count() <= line_dedup.COPIES * len(lines)
    assert rest.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] <= 2 * line_dedup.CELL
    found = line_dedup.verified_links(rest, texts, 0.8).unionByName(links).collect()
    assert linked_classes((r.a, r.b) for r in found) == linked_classes(brute_links(lines))


def test_texts_behind_the_filter_of_lines(monkeypatch, spark):
    """Candidates too many for a broadcast: lines that are none of them are dropped where they are read."""
    monkeypatch.setattr("chainlens.llm.common.BROADCAST_BYTES", 100)
    rng = random.Random(14)
    rows = [(k, "\n".join(near_copies(rng, 3, 20) + [f"line {rng.random()} of its own"]), "en", "s", 0) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    filtered = []
    listed = line_dedup.maybe_listed
    monkeypatch.setattr(line_dedup, "maybe_listed", lambda *x: filtered.append(listed(*x)) or filtered[-1])
    assert Counter((r.doc_id, r.text, r.kept_text) for r in dedup_lines(df).collect()) == expected(rows)
    assert len(filtered) == 1 and filtered[0].count() < 80
