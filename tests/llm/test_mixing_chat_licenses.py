import hashlib
import random
import re
import textwrap

from corpusloom.llm.chat import link_quotes, parse_message, split_levels
from corpusloom.llm.licenses import TEMPLATES, guard_words, license_scan, template_weights
from corpusloom.llm.mixing import mix_sources


def pour(budget, children):
    """Deal a budget to (weight, capacity) children: round by round to those that are not full."""
    got, open_ = [0.0] * len(children), {i for i, (w, c) in enumerate(children) if w and c}
    left = min(budget, sum(c for w, c in children if w))
    while open_ and left > 1e-9:
        unit = left / sum(children[i][0] for i in open_)
        full = {i for i in open_ if got[i] + unit * children[i][0] >= children[i][1] - 1e-9}
        for i in full or set(open_):
            add = children[i][1] - got[i] if full else unit * children[i][0]
            got[i] += add
            left -= add
        open_ -= full
        if not full:
            break
    return got


def plain_mix(rows, share, epochs, seed, dw, lw):
    docs = []
    for d, text, lang, source in rows:
        number = re.search(r"(\d{1,9})$", source or "")
        domain = f"dom{int(number[1]) % 4}" if number else "other"
        docs.append((d, domain, lang or "unknown", source or "unknown", len((text or "").split())))
    leaves = {}
    for _, *leaf, n in docs:
        leaves[tuple(leaf)] = leaves.get(tuple(leaf), 0) + n
    cap = lambda keep: sum(n * epochs for leaf, n in leaves.items() if keep(leaf) and dw.get(leaf[0], 1) and lw.get(leaf[1], 1))
    domains = sorted({x[0] for x in leaves})
    budgets = {}
    for d, b in zip(domains, pour(int(sum(leaves.values()) * share), [(dw.get(d, 1), cap(lambda x, d=d: x[0] == d)) for d in domains])):
        langs = sorted({x[1] for x in leaves if x[0] == d})
        for g, b2 in zip(langs, pour(b, [(lw.get(g, 1), cap(lambda x, d=d, g=g: x[:2] == (d, g))) for g in langs])):
            own = sorted(x for x in leaves if x[:2] == (d, g))
            budgets |= dict(zip(own, pour(b2, [(1, cap(lambda x, o=o: x == o)) for o in own])))
    out = []
    for leaf, b in budgets.items():
        b, n = int(b + 1e-6), leaves[leaf]
        full, rest = divmod(b, n) if n else (0, 0)
        key = lambda x: (hashlib.md5(f"{seed}:{full}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or -1, x[4])
        upto = 0
        for x in sorted((x for x in docs if tuple(x[1:4]) == leaf), key=key):
            upto += x[4]
            copies = min(epochs, full + (upto <= rest))
            if copies:
                out.append((x[0] if x[0] is not None else -1, *x[1:], copies))
    return sorted(out)


def test_mix_is_the_plain_one(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(40)) or None, rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", "src2", "src5", "src7", "web", None])) for i in range(400)]
    rows += [rows[3], (None, "a b c", "en", "src2"), (401, "\n".join(["x"] * 30_000), "es", "src3")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, copies int")
    for share, epochs, dw, lw in ((0.6, 4, {"dom0": 4, "dom1": 3}, {"en": 4}), (0.95, 1, {"dom0": 5, "dom2": 0}, {"de": 9}), (3.0, 2, {}, {})):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.domain, r.lang, r.source, r.n_tokens, r.copies) for r in mix_sources(table, share, epochs, 5, dw, lw).collect())
        assert got == plain_mix(rows, share, epochs, 5, dw, lw)
    assert mix_sources(table.where("false")).count() == 0


def test_levels():
    assert split_levels("> a\n>> b\n> > c\nd >e") == [(1, "a"), (2, "b"), (2, "c"), (0, "d >e")]
    own, units, quotes, depth = parse_message("Hi X wrote:\n> one two three\n>> four five six\n\nmy own answer")
    assert own == "my own answer" and len(units) == 1 and [q[0] for q in quotes] == [1, 2] and depth == 2
    assert parse_message(None) == ("", [], [], 0)


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there my friend, how are you?\nThe second line is here."), (1, 1, "assistant", "> hello there  my friend, HOW are you\nI am fine, thanks a lot."),
        (1, 2, "user", "On Monday X wrote:\n> I am fine, thanks a lot.\n>> hello there my friend, how are you\n\nGood to hear that indeed."), (1, 3, "user", "An unrelated new topic begins"),
        (1, 4, "a", "> > hello there my friend, how are you\nok"), (1, 5, "a", "> a passage that nobody wrote\nwell"), (2, 0, None, None), (None, 1, "u", "x"), (3, 0, "u", ""), (3, 0, "u", ""), (2, 9, "u", "> An unrelated new topic begins\nother conversation"),
    ]
    rows += [(7, t, "u", f"> the root of it all is here\nreply number {t} to it") for t in range(1, 300)] + [(7, 0, "u", "the root of it all is here"), (7, 300, "u", "w " * 50_000)]
    got = link_quotes(spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, position int")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].reply_to, by[1, t].thread, by[1, t].position) for t in range(6)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 4), (0, 0, 3), (None, 5, 5)]
    assert by[1, 2].text == "Good to hear that indeed." and by[1, 2].n_linked == 2 and by[2, 9].reply_to is None and by[2, 0].text == ""
    assert sorted(r.position for r in got if r.conv_id == 3) == [0, 1] and all(by[7, t].reply_to == 0 and by[7, t].position == t for t in range(1, 300))
    assert link_quotes(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def made_threads(seed, conversations=25, turns=14):
    """Rows of made conversations, and by (conv_id, turn) the parent, own text and number of quoted passages of earlier turns."""
    rng, rows, truth = random.Random(seed), [], {}
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    for conv in range(conversations):
        own, parents = {}, {}
        for turn in range(turns):
            own[turn] = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(rng.randint(1, 4))]
            parents[turn] = parent = rng.choice([None, *range(turn)]) if turn else None
            lines, linked, above, level = [], 0, parent, 1
            blocks = []
            while above is not None and level <= rng.choice((1, 2, 4)):
                taken = sorted(rng.sample(range(len(own[above])), rng.randint(1, len(own[above]))))
                blocks.append((level, [own[above][k] for k in taken]))
                above, level = parents[above], level + 1
            mark = lambda n: rng.choice(("", " ")).join(">" * n) + " " if n else ""
            said = lambda: rng.choice((["X wrote:"], ["On Monday, the 3rd of May, X Y", "<x@y> wrote:"], ["Y schrieb:", ""]))
            for n in range(1, len(blocks) + 1):
                lines += [mark(n - 1) + x for x in said()]
            for n, paragraphs in reversed(blocks):
                width = rng.randint(30, 80)
                for k, paragraph in enumerate(paragraphs):
                    lines += ([mark(n)] if k else []) + [mark(n) + x.upper() for x in textwrap.wrap(paragraph, width)]
            text = "\n\n".join(own[turn])
            rows.append((conv, turn, "u", "\n".join([*lines, "", text]) if lines else text))
            truth[conv, turn] = (parent, text, [(n, p) for n, p in blocks])
    return rows, truth


def test_made_threads_are_linked(spark):
    """Nested, attributed and re-wrapped quotes of made threads, against how they were made."""
    for seed in (1, 2):
        rows, truth = made_threads(seed)
        got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()}
        assert got.keys() == truth.keys()
        for (conv, turn), (parent, text, blocks) in truth.items():
            r, root = got[conv, turn], turn
            while truth[conv, root][0] is not None:
                root = truth[conv, root][0]
            assert (r.reply_to, r.thread, r.text, r.quote_depth) == (parent, root, text, len(blocks)), (conv, turn, rows[conv * 14 + turn][3])
            assert r.n_linked >= sum(len(p) for _, p in blocks)
        for conv in {c for c, _ in truth}:
            ordered = sorted((r for r in got.values() if r.conv_id == conv), key=lambda r: (r.thread, r.turn))
            assert [r.position for r in ordered] == list(range(len(ordered)))


def test_rows_of_one_turn_are_one_message(spark):
    rows = [(1, 0, "u", "the first message of all here"), (1, 1, "u", "> the first message of all here\nyes"), (1, 1, "u", "something else on the same turn"), (1, 2, "u", "> something else on the same turn\nso")]
    got = sorted((r.turn, r.text, r.reply_to) for r in link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())
    assert got == [(0, rows[0][3], None), (1, "something else on the same turn", 0), (1, "yes", 0), (2, "so", 1)]


def test_guards_lose_nothing():
    rows, _, _ = template_weights(TEMPLATES)
    guards = set(guard_words(rows, 0.8))
    for number in {r[0] for r in rows}:
        assert sum(w * w for n, _, x, w in rows if n == number and x not in guards) < 0.64


def test_licences(spark):
    mit = TEMPLATES["MIT"][2]
    rows = [
        ("a/LICENSE", mit + ", subject"), ("a/x.py", "code here"), ("a/b/c/y.py", "some code\nLicensed under CC BY-NC 4.0.\nmore of the code and on and on"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/b/d/z.py", None), ("q/w.py", ""), (None, "hello"), ("LICENSE", "All rights reserved."), ("a/b/two.py", "long text that goes on\nReleased under the MIT License.\nLicensed under CC BY 4.0.\nand goes on and on and on and on"),
        ("a/b/d/z.py", None), ("q/notice", "This licence is ours and free of anything"),
    ]
    got = license_scan(spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, license string")).collect()
    assert len(got) == len(rows)
    by = {r.path: (r.license, r.origin, r.license_dir) for r in got}
    assert by == {
        "a/LICENSE": ("MIT", "file", "a"), "a/x.py": ("MIT", "ancestor", "a"), "a/b/c/y.py": ("CC-BY-NC-4.0", "header", None), "a/b/LICENSE.txt": ("Apache-2.0", "file", "a/b"),
        "a/b/d/z.py": ("Apache-2.0", "ancestor", "a/b"), "q/w.py": ("All-rights-reserved", "ancestor", ""), None: ("All-rights-reserved", "ancestor", ""), "LICENSE": ("All-rights-reserved", "file", ""),
        "a/b/two.py": ("CC-BY-4.0 AND MIT", "header", None), "q/notice": ("All-rights-reserved", "ancestor", ""),
    }
    none = license_scan(spark.createDataFrame([("p/a", "nothing")], "path string, text string")).first()
    assert (none.license, none.origin) == (None, "none")
    assert license_scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_notices(spark):
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal', "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are", "met:"]
    code = ["import os", "for line in lines:", "    print(line, os.sep, again, and, more, of, the, code)"] * 6
    rows = [
        ("g/a.py", "\n".join([f"# {x}" for x in gpl] + code)), ("g/b.c", "/*\r\n * Copyright (C) 2020 A. Body\r\n *\r\n" + "\r\n".join(f" * {x}" for x in gpl) + "\r\n */\r\nint x;" + "\r\nint y = 1;" * 60),
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + "\n".join(mit)), ("m/src/x.py", "code"),
        ("b/c.js", "\n".join(code + [f"// {x}" for x in [*bsd, "1. Keep this notice."]] + code)), ("n/none.py", "\n".join(code)),
    ]
    got = {r.path: (r.license, r.origin) for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "g/a.py": ("GPL-3.0", "header"), "g/b.c": ("GPL-3.0", "header"), "m/LICENSE": ("MIT", "file"), "m/src/x.py": ("MIT", "ancestor"),
        "b/c.js": ("BSD-3-Clause", "header"), "n/none.py": (None, "none"),
    }
