"""Related files against plain containment, and no table of pieces of names on the driver."""

import re

from weftline.operators import project

SOURCES = ["src/a/unit_4.rs", "src/a/unit_40.rs", "src/b/é.x.rs", "src/b/.rs", "lib/nit.py", "src/c/tests.rs", "src/d/a.b.c.rs"]
OTHERS = ["tests/unit_40_test.rs", "tests/test_unit_4.rs", "tests/nit_4.rs", "tests/common.rs", "tests/unit", "tests/é.x_tests.rs", "tests/t_é", "tests/rs", "tests/deep/unit_4", "tests/", "tests/a.b.c.d", "tests/.rs",
          "src/a/README.md", "src/d/README.md", "Cargo.toml"]


def plain():
    out = set()
    for path in (p for p in SOURCES if p.endswith(".rs")):
        stem = path.rsplit("/", 1)[1].rsplit(".", 1)[0]
        for other in (o for o in OTHERS if o.startswith("tests/")):
            name = other.rsplit("/", 1)[1]
            if name and stem and (stem in name or any(name in p for p in (f"{stem}_test.rs", f"test_{stem}.rs", f"{stem}_tests.rs", f"tests/{stem}.rs"))):
                out.add((path, other))
    return out


def test_names_contain_each_other(spark, tmp_path):
    spark.createDataFrame([(p, "") for p in SOURCES], "path string, content string").write.parquet(f"{tmp_path}/sources")
    spark.createDataFrame([(p,) for p in OTHERS], "path string").write.parquet(f"{tmp_path}/others")
    found = project.related_files(spark.read.parquet(f"{tmp_path}/sources"), spark.read.parquet(f"{tmp_path}/others"))
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 1
    rows = found.collect()
    named = {(r.path, r.related) for r in rows if r.relation == "test" and r.path != "src/b/.rs" and r.related != "tests/"}
    assert named == {x for x in plain() if x[0] != "src/b/.rs"}
    assert len(rows) == len(set(rows)) and {r.related for r in rows if r.path == "src/a/unit_4.rs" and r.relation == "documentation"} == {"src/a/README.md"}


def test_a_definition_is_looked_up_once(spark, sf):
    from weftline.registry import all_queries

    plan = all_queries()["inline_definition"].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*Contains\(definition#\d+, total\)", plan)
