import random
from datetime import datetime

from symgraph.llm.handwritten import LARGE, not_handwritten

T = datetime(2031, 1, 1)
FILES = "file_id long, repo_id string, rel_path string, language string, size long, indexed_at timestamp, rule string, class int"


def code(seed, n=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    return "\n".join(f"func {word()}({word()} int, {word()} string) error {{ return {word()}({word()}) }}" for _ in range(n)) + "\n"


def judge(spark, rows):
    """rows: path, text[, repository, size]."""
    files = [(k, r[2] if len(r) > 2 else f"own{k}", r[0], "go", r[3] if len(r) > 3 else 100, T, "x", 1) for k, r in enumerate(rows)]
    contents = [(k, r[1]) for k, r in enumerate(rows)]
    found = not_handwritten(spark.createDataFrame(files * 2, FILES), spark.createDataFrame(contents, "file_id long, content string"))
    return {r.file_id: r.rule for r in found.collect()}


def test_rules(spark):
    lib = code("lib")
    edited = lib.replace("return", "return ", 3).replace("error", "(int, error)", 2)
    minified = "!function(){" + "var a=b(c),d=e.f;if(a){return d(a)}else{g(a,d)};" * 40 + "}();"
    blob = "var data = []string{\n" + "\n".join(f'  "{k:064x}",' for k in range(40)) + "\n}\n"
    accessors = "\n".join(f"def get_field_{k}(row):\n    return row[{k}]\n" for k in range(30))
    rows = [
        ("src/a.go", code(1)), ("vendor/x/a.go", code(2)), ("vendors/a.go", code(3)), ("src/a.pb.go", code(4)), ("src/report_generator.go", code(5)), ("generated/x.go", code(6)), ("generator/x.go", code(7)),
        ("src/b.go", "// Code generated by tool. DO NOT EDIT.\n" + code(8)), ("src/c.go", "// Writes the generated report; do not edit the rows.\n" + code(9)),
        ("src/d.go", code(10) + 'const banner = "// Code generated by tool. DO NOT EDIT."\n'), ("src/e.go", "// x v1 - (c) the x authors, released under the Open Licence\n" + code(11)),
        ("src/f.go", "// Copyright (c) Our Works. All rights reserved. Internal use only.\n" + code(12)), ("src/g.js", minified), ("src/h.go", code(13) + 'const help = "' + "long words " * 80 + '"\n'),
        ("src/i.go", blob), ("src/j.py", accessors), ("lib/k.go", lib, "r1"), ("core/l.go", "// Ours.\n" + edited, "r2"), ("app/m.go", lib.replace(" ", "  "), "r3"), ("src/n.go", None, "r4", LARGE + 1),
        ("src/o.go", ""), ("src/p.go", "// only a comment\n"), (None, code(14), None, None), ("src/q.go", code(15)[:200]), ("src/r.go", code("twice"), "same"), ("src/s.go", code("twice"), "same"),
    ]
    got = judge(spark, rows)
    names = {rows[k][0]: v for k, v in got.items()}
    assert set(names) == {"vendor/x/a.go", "src/a.pb.go", "generated/x.go", "src/b.go", "src/e.go", "src/g.js", "src/i.go", "src/j.py", "lib/k.go", "core/l.go", "app/m.go", "src/n.go"}
    assert names["core/l.go"] == names["lib/k.go"] == "copy" and names["src/n.go"] == "large" and names["src/g.js"] == "minified" and names["src/i.go"] == "data"


def test_group_of_copies_that_holds_a_third_of_all_files(spark):
    lib = code("hot")
    rows = [(f"x/{k}.go", lib.replace("{", "{" + " " * (k % 3)), f"r{k}") for k in range(120)] + [(f"y/{k}.go", code(f"own{k}"), f"r{k}") for k in range(240)]
    got = judge(spark, rows)
    assert set(got) == set(range(120))


def edited(text, seed, n):
    """`text` with n lines replaced."""
    rng, lines = random.Random(f"edit{seed}"), text.splitlines()
    for k in rng.sample(range(len(lines)), n):
        lines[k] = code(f"{seed}-{k}", 1).strip()
    return "\n".join(lines) + "\n"


def test_both_of_two_edited_copies_are_found_in_whatever_repositories(spark):
    rows = [(f"x/{k}-{side}.go", edited(code(f"lib{k}"), f"{k}-{side}", 2), f"r{k}-{side}") for k in range(30) for side in "ab"]
    # A file of the same repository that has all the lines and comes first must not hide the far copy.
    rows = [("x/near.go", code("near") + code("more", 40), "here"), *rows, ("x/own.go", edited(code("near"), 1, 1), "here"), ("x/far.go", edited(code("near"), 2, 1), "there")]
    assert set(judge(spark, rows)) == set(range(1, len(rows)))


def test_every_holder_of_a_line_is_compared(spark):
    # The lines of the last file stand together in one file only, and each of them in many others that come first.
    lines = code("spread", 12).splitlines()
    rows = [(f"x/{k}-{j}.go", code(f"{k}-{j}") + line + "\n", f"r{k}-{j}") for k, line in enumerate(lines) for j in range(15)]
    rows += [("x/all.go", "\n".join(lines) + "\n", "p"), ("x/part.go", "\n".join(lines[:9]) + "\n" + code("rest", 3), "q")]
    assert set(judge(spark, rows)) == {len(rows) - 2, len(rows) - 1}


def test_edited_copies_of_one_library_that_hold_a_third_of_all_files(spark):
    lib = code("hot", 20)
    rows = [(f"x/{k}.go", edited(lib, k, 2), f"r{k}") for k in range(60)] + [(f"y/{k}.go", code(f"own{k}"), f"r{k}") for k in range(120)]
    assert set(judge(spark, rows)) == set(range(60))


def test_same_code_is_a_copy_if_its_lines_are_common_or_few(spark):
    lib = code("hot", 20)
    rows = [(f"x/{k}.go", edited(lib, k, 2), "one") for k in range(60)] + [("x/a.go", lib, "p"), ("x/b.go", "// Ours.\n" + lib, "q"), ("x/c.go", code("few", 3), "p"), ("x/d.go", code("few", 3), "q")]
    assert set(judge(spark, rows)) >= {60, 61, 62, 63}
    # Few common lines that two files share by chance are none.
    idioms = code("idioms", 5).splitlines()
    rows = [(f"x/{k}.go", code(f"own{k}", 3) + "\n".join(idioms) + "\n", f"r{k}") for k in range(40)]
    assert not judge(spark, rows)


def test_empty(spark):
    files = spark.createDataFrame([], FILES)
    assert not_handwritten(files, spark.createDataFrame([], "file_id long, content string")).count() == 0
    one = spark.createDataFrame([(1, "r", "vendor/a.go", "go", 1, T, "", 1)], FILES)
    assert not_handwritten(one, spark.createDataFrame([], "file_id long, content string")).count() == 1


def test_a_banner_below_a_long_licence_is_seen(spark):
    code = "package a\n\nfunc F%d() int {\n\treturn %d\n}\n"
    licence = "".join(f"// Line {k} of a licence of Quarrystone Works that goes on.\n" for k in range(40))
    texts = {
        1: licence + "// Code generated by protomill. DO NOT EDIT.\n" + code % (1, 1),
        2: licence + code % (2, 2) + "// Code generated by hand, said nobody.\n",
        3: (licence + "// Code generated by protomill. DO NOT EDIT.\n" + code % (3, 3)).replace("\n", "\r"),
        4: licence,
    }
    files = spark.createDataFrame([(k, "r", f"src/a{k}.go", "go", 100, None, "x") for k in texts], "file_id long, repo_id string, rel_path string, language string, size long, indexed_at timestamp, content string")
    contents = spark.createDataFrame(list(texts.items()), "file_id long, content string")
    assert {(r.file_id, r.rule) for r in not_handwritten(files, contents).collect()} == {(1, "generated banner"), (3, "generated banner")}
