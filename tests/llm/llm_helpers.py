"""Comparison helpers and odd tables."""

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'xyz'[rng.randrange(3)]}" for _ in range(n)]


def prose(rng, n):
    out = []
    for i, w in enumerate(words(rng, n)):
        out.append(w + ("." if i % 9 == 8 else "") + ("\n" if i % 40 == 39 else " "))
    return "".join(out).strip()


def odd_documents():
    rng = random.Random(5)
    base = prose(rng, 130)
    edited = base.split(" ")
    edited[40] = "changed"
    leak = " ".join(words(random.Random(77), 30))
    texts = [
        base, None, "", "   \n\t ", "one", "two words", base, base.upper(), " ".join(edited), prose(rng, 400),
        prose(rng, 60) + " " + leak + " " + prose(rng, 60), "É é Ü ü 漢字 " * 30, "Und " * 200, prose(rng, 9000),
        "$$$ ### " * 80, "A b\x0bc\x0cd\re  f   g\n\n h \n i", "line one here\n" * 30, base + " tail " + leak, prose(rng, 120),
        "x" * 300, "x" * 99, "x" * 100, prose(rng, 80) + '\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end',
        leak, " ".join(leak.split(" ")[:9]), "<|endoftext|> <s> [INST] it's don't 5€ ½", "\x00 a\x00b " * 20,
    ]
    n = len(texts)
    return {"doc_id": list(range(0, 3 * n, 3)), "text": texts, "lang": ["en"] * n,
            "source": [None if i % 7 == 3 else f"s{i % 3}" for i in range(n)], "n_chars": [len(t or "") for t in texts],
            # names the operators use themselves
            "n_words": ["clash"] * n, "component_id": [None] * n, "ord": [1] * n, "pns": ["x"] * n, "kept": [True] * n}


def odd_embeddings():
    """Many ties, repeated rows, and rows that take no part."""
    rng = random.Random(11)
    rows = [(i, [rng.randrange(-6, 7) / 16 for _ in range(6)], rng.randrange(4)) for i in range(0, 700, 5)]
    rows += [rows[0], rows[0], (100, rows[3][1], rows[3][2]), (35, rows[20][1], None), (40, None, 1), (45, [0.5] * 5 + [None], 1),
             (50, [0.5] * 5 + [float("nan")], 1), (55, [0.5] * 5 + [float("inf")], 1), (None, [0.25] * 6, 1), (None, [0.375] * 6, 2),
             (800, [0.0] * 6, 3), (900, [-0.25] * 6, 9), (None, None, None)]
    return {"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": [r[2] for r in rows],
            "id": ["clash"] * len(rows), "anchor": [True] * len(rows), "v": [None] * len(rows), "cell": [0] * len(rows)}


def odd_tables():
    leak = " ".join(words(random.Random(77), 30))
    big = "<p>" + "payload " * 200 + "</p>"
    pages = {
        "page_id": list(range(12)),
        "url": ["http://WWW.Example.com/en/a?x=1#f", None, "no scheme", "https://a.net/es/", "https://a.net/es/x/?utm_source=q",
                "https://b.org/one", "https://b.org/one/", "http://c.org", "http://example.com/en/", "https://x.com/", "http://d d.com/é",
                "https://b.org/two"],
        "html": [big, big, None, "", "short", '<link rel="canonical" href="https://q.net/es/z">', big + "x",
                 "<meta http-equiv='refresh' content='0; url=/two'>é漢", big, "<link href='/b' rel=canonical>", "\r\n\r\n\n WARC/1.0\r\n", big],
        "extra": [1] * 12}
    conversations = {
        "conv_id": [1, 1, 1, 2, 2, 3, 4, 4, 4], "turn": [1, 0, 2, 0, 1, 0, 0, 1, 1],
        "role": ["assistant", "user", "assistant", "system", "assistant", None, "user", "assistant", "assistant"],
        "text": ["a é", "q\n", None, "<|im_end|>\n\\", "\\<s>\\\\", "", "[INST] <<SYS>>", "x", "x"], "part": [0] * 9}
    benchmark = {"item_id": [1, 2, 3, 4, 5, 6], "text": [leak, None, "", "one", leak.upper(), "two words"], "win": [0] * 6}
    labels = {"doc_id": [0, 3, 42], "quality": [1, 0, 0], "toxic": [0, 0, 0]}
    return {"documents": odd_documents(), "pages": pages, "conversations": conversations, "benchmark": benchmark, "labels": labels,
            "embeddings": odd_embeddings()}


KINDS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(),
         "page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "item_id": pa.int64(), "conv_id": pa.int64(),
         "vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32(), "v": pa.string(),
         "turn": pa.int64(), "role": pa.string(), "quality": pa.int32(), "toxic": pa.int32()}


def write(folder, tables):
    for name, cols in tables.items():
        arrays = {k: pa.array(v, KINDS[k]) if k in KINDS else pa.array(v, pa.string() if k == "component_id" else None)
                  for k, v in cols.items()}
        pq.write_table(pa.table(arrays), os.path.join(folder, f"{name}.parquet"))
    return str(folder)


def norm(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=repr)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    con.execute("SET memory_limit='4GB'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
