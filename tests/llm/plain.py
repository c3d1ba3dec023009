"""Plain versions of the corpus operators, one row after another, and helpers of their tests."""

import hashlib
import re
from collections import defaultdict
from pathlib import Path

import xxhash

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def have_data() -> bool:
    return Path(SMALL).exists()


def rows(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def documents(spark, texts, **more):
    """A table of documents with these texts, doc_id from 0, and columns whose names clash with those the operators make."""
    data = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fp string, n int")


def tables_left(spark) -> set[str]:
    """The tables that operators have written to the shared folder and not dropped."""
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("loom-*")}


def against_sql(spark, query, sql, sf_dir=SMALL):
    """Rows of a query and of its SQL, columns by name, values compared exactly but for floats at six digits."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    key = lambda found: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return key(tuple(r) for r in df.select(*columns).collect()), key(expected)


def sql_on(tables: dict, sql: str, columns: list[str]) -> list[tuple]:
    """Rows of a SQL text over pandas tables."""
    import duckdb

    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- personal data


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0


def pii_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, order, kind, end) of the base kinds, straight from the contract's patterns."""
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


# --- quality


def quality_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


# --- near-duplicates


def shingles(text: str | None, width: int) -> list[str]:
    w = WORD.findall(lower(text or ""))
    if not w:
        return []
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


def simhash(text: str | None, width: int = 3) -> int:
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def jaccard(a: str | None, b: str | None, width: int = 5) -> float:
    x, y = set(shingles(a, width)), set(shingles(b, width))
    return len(x & y) / len(x | y) if x | y else 1.0


def components(nodes, edges) -> dict:
    """Every node with the least one that it reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_classes(docs: dict, threshold: int = 2) -> tuple[dict, dict]:
    fp = {i: simhash(t) for i, t in docs.items()}
    ids = sorted(docs)
    return fp, components(ids, ((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= threshold))


# --- lines


def line_chunks(text: str, every: int) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines of a text and its chunks, lines from b up to e."""
    lines = [x for x in re.findall(r"[^\n]{40,}?[.!?] |[^\n]*(?:\n|\Z)", text) if x]
    h = [int(hashlib.md5(x.rstrip(" \n").encode()).hexdigest()[:14], 16) for x in lines]
    at = [i for i in range(len(lines)) if i == 0 or ((31 * h[i - 2] if i > 1 else 0) + h[i - 1]) % (2**61 - 1) % 16 < every]
    return lines, list(zip(at[: max(1, len(at) - 1)], at[2:] + [len(lines)])) if lines else []


def line_dedup(docs: list[tuple], every: int, least: int) -> list[tuple]:
    """(doc_id, cleaned text, chunks, removed, removed lines) of (doc_id, text)."""
    cut = [line_chunks(t or "", every) for _, t in docs]
    said = lambda lines, b, e: "\n".join(x.rstrip(" \n") for x in lines[b:e])
    fit = lambda lines, b, e: e - b >= 2 and len(said(lines, b, e)) >= least
    first: dict = {}
    for (i, _), (lines, found) in zip(docs, cut):
        for b, e in found:
            if i is not None and fit(lines, b, e):
                first[said(lines, b, e)] = min(first.get(said(lines, b, e), i), i)
    out = []
    for (i, t), (lines, found) in zip(docs, cut):
        gone = [(b, e) for b, e in found if i is not None and fit(lines, b, e) and first[said(lines, b, e)] < i]
        lost = {k for b, e in gone for k in range(b, e)}
        out.append((i, "".join(x for k, x in enumerate(lines) if k not in lost) if gone else t, len(found), len(gone), len(lost)))
    return out


# --- benchmark overlaps


def overlaps(docs: dict, items: dict, masks, least_score: int) -> dict:
    """(doc, item) -> (score, start)."""
    tokens = lambda t: WORD.findall(lower(t or ""))
    table, lists = defaultdict(list), {k: tokens(t) for k, t in items.items()}
    ones = [(len(m), [i for i, x in enumerate(m) if x == "1"]) for m in masks]
    for k, w in lists.items():
        if len(w) >= least_score:
            for m, (n, at) in enumerate(ones):
                for i in range(len(w) - n + 1):
                    table[m, tuple(w[i + j] for j in at)].append((k, i))
    out: dict = {}
    for d, t in docs.items():
        w = tokens(t)
        shifts = {(k, i - j) for m, (n, at) in enumerate(ones) for i in range(len(w) - n + 1) for k, j in table.get((m, tuple(w[i + x] for x in at)), ())}
        for k, shift in shifts:
            start, now, best = max(shift, 0), 0, 0
            for p in range(start, min(len(w), shift + len(lists[k]))):
                now = max(0, now + (1 if w[p] == lists[k][p - shift] else -2))
                best = max(best, now)
            if best >= least_score:
                out[d, k] = max(out.get((d, k), (0, 0)), (best, -start))
    return {k: (s, -b) for k, (s, b) in out.items()}


# --- packing


def best_fit(pieces, capacity: int, max_per_source: int) -> list[int]:
    """The tightest compatible bin for each piece, among equally tight ones any: residuals taken, in order."""
    bins: list[dict] = []
    out = []
    for size, source, cluster in pieces:
        fit = [b for b in bins if b["left"] >= size and (source is None or b["sources"].count(source) < max_per_source) and (cluster is None or cluster not in b["clusters"])]
        b = min(fit, key=lambda b: b["left"], default=None)
        if b is None:
            bins.append(b := {"left": capacity, "sources": [], "clusters": set()})
        out.append(b["left"])
        b["left"] -= size
        b["sources"].append(source)
        b["clusters"].add(cluster)
    return out
