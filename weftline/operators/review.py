"""Review of Rust files: issues, smells, untested functions, score, grade and suggestions; row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import code

CONTROL = r"\b(if|match|while|loop|for)\b"
MAX_COMPLEXITY, MAX_NESTING, MAX_PARAMS, MAX_ITEMS = 10, 4, 5, 20


def _quoted(prefix: str, name: Column, *rest) -> Column:
    return F.concat(F.lit(prefix + "'"), name, F.lit("'"), *[r if isinstance(r, Column) else F.lit(r) for r in rest])


def _suggestion(category: str, message: Column, severity: str) -> Column:
    return F.struct(F.lit(category).alias("category"), message.alias("message"), F.lit(severity).alias("severity"))


def review(files: DataFrame) -> DataFrame:
    """Add ``style, complex, deep, smells, untested, score, grade, suggestions`` to Rust files.

    Functions inside impl and trait blocks are not reviewed on their own, as only free functions are visited.
    """
    s = code.with_structure(files)

    def inside(f, b):
        return (f["line_start"] > b["line_start"]) & (f["line_start"] <= b["line_end"])

    def free_functions(blocks):
        return F.filter("symbols", lambda f: (f["kind"] == "Function") & ~F.exists(blocks, lambda b: inside(f, b)))

    def with_text(f):
        text = F.array_join(F.slice("lines", f["line_start"], F.greatest(f["line_end"] - f["line_start"] + 1, F.lit(0))), "\n")
        return F.struct(f["name"].alias("name"), F.size(f["params"]).alias("params"), tx.trim(f["above"]).rlike(r"^#\[(test|tokio)").alias("is_test"), text.alias("text"))

    def measured(f):
        return F.struct(f["name"].alias("name"), f["params"].alias("params"), f["is_test"].alias("is_test"),
                        (F.regexp_count(f["text"], F.lit(CONTROL)) + 1).alias("score"), code.control_depth(f["text"]).alias("depth"))

    blocks = F.filter("symbols", lambda x: x["kind"].isin("Module", "Trait"))
    free = tx.let(blocks, lambda b: F.transform(F.transform(free_functions(b), with_text), measured))
    impls = F.filter("symbols", lambda x: x["kind"] == "Module")
    methods = F.filter("symbols", lambda x: x["kind"] == "Function")
    gods = tx.let(methods, lambda fs: F.filter(F.transform(impls, lambda b: F.struct(b["name"].alias("name"), F.size(F.filter(fs, lambda f: inside(f, b))).alias("items"))),
                                               lambda b: b["items"] > MAX_ITEMS))
    numbers = F.regexp_extract_all("content", F.lit("([A-Za-z0-9_.]+)"), F.lit(1))
    magic = F.filter(numbers, lambda w: w.rlike("^[0-9]+$") & ~w.try_cast("bigint").isin(0, 1))
    tests = F.transform(F.filter("_free", lambda f: f["is_test"]), lambda f: f["name"])
    plain = F.filter("_free", lambda f: ~f["is_test"] & ~F.startswith(f["name"], F.lit("_")))
    s = (
        s.withColumn("_free", free).withColumn("_gods", gods).withColumn("_magic", magic).withColumn("style", code.style_score(F.col("content")))
        .withColumn("complex", F.filter("_free", lambda f: f["score"] > MAX_COMPLEXITY))
        .withColumn("deep", F.filter("_free", lambda f: f["depth"] > MAX_NESTING))
        .withColumn("_long", F.filter("_free", lambda f: f["params"] > MAX_PARAMS))
        .withColumn("untested", tx.let(tests, lambda ts: F.filter(plain, lambda f: ~F.exists(ts, lambda t: F.contains(t, f["name"])))))
    )
    s = s.withColumn("smells", (F.size("_long") + F.size("_gods") + F.size("_magic")).cast("bigint"))
    score = code.review_score(F.col("style"), F.size("complex") + F.size("deep"), F.col("smells"), F.size("untested"))
    none = F.array().cast("array<struct<category:string,message:string,severity:string>>")
    suggestions = F.concat(
        F.transform("complex", lambda f: _suggestion("Complexity", _quoted("Consider breaking down ", f["name"], " (complexity: ", f["score"].cast("string"), ") into smaller functions"), "Warning")),
        F.transform("deep", lambda f: _suggestion("Readability", _quoted("Function ", f["name"], " has nesting depth ", f["depth"].cast("string"), ". Use early returns or extract methods"), "Warning")),
        F.transform("_magic", lambda w: _suggestion("Maintainability", F.concat(F.lit("Replace magic number "), w, F.lit(" at function with a named constant")), "Info")),
        F.transform("_long", lambda f: _suggestion("Design", _quoted("Function ", f["name"], " has ", f["params"].cast("string"), " parameters. Consider using a struct or builder pattern"), "Warning")),
        F.transform("_gods", lambda b: _suggestion("Design", _quoted("Type ", b["name"], " has ", b["items"].cast("string"), " methods. Consider splitting into smaller types"), "Critical")),
        F.when(F.size("untested") > 0, F.array(_suggestion("Testing", F.concat(F.size("untested").cast("string"), F.lit(" function(s) lack test coverage. Consider adding unit tests")), "Warning"))).otherwise(none),
        F.when(F.col("style") < 80, F.array(_suggestion("Style", F.lit("Run 'cargo fmt' to fix formatting issues"), "Info"))).otherwise(none),
    )
    out = s.withColumn("score", score).withColumn("suggestions", suggestions)
    return out.withColumn("grade", code.grade(F.col("score"))).drop("_free", "_long", "_gods", "_magic")
