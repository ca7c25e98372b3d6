"""Line dedup and chat formatting."""

from itertools import groupby

from treeline.llm import chat_format, line_dedup


def brute_lines(rows, least):
    sites = {}
    for _, t, s in rows:
        if t is not None and s is not None:
            for x in t.split("\n"):
                if x.strip(" \t\r\f\v"):
                    sites.setdefault(x, set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, None, 0))
        else:
            kept = [x for x in t.split("\n") if x not in bad]
            out.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_lines_of_many_sites_go(spark):
    rows = [(i, f"own line {i}\nfooter\n\n  \nnear {i % 8}\nshared by seven", f"site{i % 11}" if i % 11 < 7 or i % 2 else f"site{i % 20}") for i in range(60)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "footer", None), (None, "footer\nfooter\nx", "z"), (103, "footer", "q"), (103, "other", "q"), (3, rows[3][1], rows[3][2]), (104, "x\n" * 5000 + "footer", "a")]
    df = spark.createDataFrame([(*r, "y", 1) for r in rows], "doc_id bigint, text string, source string, h string, gone int")
    for least in (2, 8, 12):
        got = sorted((tuple(r) for r in line_dedup.line_dedup(df, min_sites=least).collect()), key=str)
        assert got == brute_lines(rows, least)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def brute_chats(rows):
    out = {}
    for c, n, r, t in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] or "unknown", x[3] or "")):
        out.setdefault(c, []).append((r or "unknown", t or ""))
    made = {}
    for c, turns in out.items():
        merged = [(k, [t for _, t in g]) for k, g in groupby(turns, key=lambda x: x[0])]
        made[c] = (len(turns), len(merged), "".join(f"<|im_start|>{k}\n" + "\n\n".join(ts) + "<|im_end|>\n" for k, ts in merged))
    return made


def test_chats(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (2, 1, "user", None), (2, None, "user", "n"), (2, 2, None, "z"), (2, 3, None, ""), (None, 1, "user", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "same"), (4, 1, "system", "l" * 50000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r[0]: tuple(r)[1:] for r in chat_format.format_chats(df).collect()}
    assert got == brute_chats(rows)
    assert chat_format.format_chats(df.limit(0)).count() == 0
