"""Whole-project summaries, related files and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import code
from weftline.operators.metrics import ratio
from weftline.operators.ordered import running_sum
from weftline.operators.rows import unnest
from weftline.operators.sizing import small_or_shuffled


def project_counts(files: DataFrame, project: Column) -> DataFrame:
    """Counts per project; each file is counted inside its row before anything is shuffled."""
    s = code.with_structure(files)

    def count(test):
        return F.size(F.filter("symbols", test))

    documented = lambda x: F.startswith(tx.trim(x["above"]), F.lit("///"))
    per_file = s.select(
        project.alias("project"), "language", F.size("lines").alias("lines"), F.octet_length("content").alias("bytes"), F.size("symbols").alias("n"),
        F.aggregate("symbols", F.lit(0).cast("bigint"), lambda a, x: a + x["complexity"]).alias("complexity"), count(lambda x: x["visibility"] == "Public").alias("public"),
        count(lambda x: x["complexity"] > 10).alias("complex"), count(lambda x: x["complexity"] > 15).alias("very_complex"), count(documented).alias("documented"),
        count(lambda x: (x["visibility"] == "Public") & ~documented(x)).alias("undocumented"), count(lambda x: tx.trim(x["above"]) == "#[test]").alias("tests"),
        count(lambda x: F.contains(x["head"], F.lit("async "))).alias("asyncs"), count(lambda x: x["kind"] == "Function").alias("functions"))
    sums = ["lines", "n", "complexity", "public", "complex", "very_complex", "documented", "undocumented", "tests", "asyncs", "functions"]
    per_language = per_file.groupBy("project", "language").agg(F.count("*").alias("files"), F.count_if(F.col("bytes") > 10_000).alias("large"), *[F.sum(c).alias(c) for c in sums])
    # The main language has most lines, of equals the first by name.
    main = F.min_by("language", F.struct(-F.col("lines"), "language"))
    return per_language.groupBy("project").agg(
        F.sum("files").alias("files"), F.sum("large").alias("large"), main.alias("language"), F.max(F.when(F.col("language").isNotNull(), F.col("lines"))).alias("main_lines"),
        *[F.sum(c).alias(c) for c in sums])


def project_metrics(counts: DataFrame) -> DataFrame:
    average = F.when(F.col("n") > 0, F.col("complexity") / F.col("n")).otherwise(1.0)
    score = F.least(F.greatest((average - 1.0) * 10.0, F.lit(0.0)), F.lit(100.0))
    c = counts.withColumn("complexity_score", score)
    index = F.greatest(100.0 - F.least(F.col("lines") / 1000.0, F.lit(30.0)) - F.col("complexity_score") / 2.0, F.lit(0.0))
    return (c.withColumn("maintainability", index).withColumn("doc_coverage", ratio(F.col("documented"), F.col("n")) * 100.0)
            .withColumn("test_coverage", F.when(F.col("functions") > 0, F.col("tests") / F.col("functions") * 100.0)))


def _said(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def insights() -> Column:
    """Findings over ``project_metrics`` columns. The texts are fixed values."""
    c = F.col
    share = F.floor(c("main_lines") * 100 / c("lines"))
    return F.array_compact(F.array(
        F.when(c("lines") > 0, _said(share, "% del código está en ", c("language"))),
        F.when(c("complex") > 0, _said(c("complex"), " funciones con complejidad alta detectadas")).otherwise("Complejidad general del código es manejable"),
        F.when(c("n") > 0, _said(F.floor(c("documented") * 100 / c("n")), "% de símbolos documentados")),
        F.when(c("tests") > 0, _said(c("tests"), " tests detectados")),
        F.when(c("asyncs") > 0, _said(c("asyncs"), " funciones asíncronas (uso de async/await)")),
        F.when(c("maintainability") >= 70, "Índice de mantenibilidad: Alto (código fácil de mantener)").when(c("maintainability") >= 50, "Índice de mantenibilidad: Medio")
        .otherwise("Índice de mantenibilidad: Bajo (considerar refactoring)")))


def recommendations() -> Column:
    c = F.col
    found = F.array_compact(F.array(
        F.when(c("undocumented") > 0, _said("Agregar documentación a ", c("undocumented"), " símbolos públicos sin documentar")),
        F.when(c("very_complex") > 0, _said("Refactorizar ", c("very_complex"), " funciones con complejidad muy alta (>15)")),
        F.when(c("large") > 5, _said("Considerar dividir ", c("large"), " archivos grandes (>10KB)")),
        F.when(c("maintainability") < 50, "Mejorar índice de mantenibilidad mediante refactoring")))
    return F.when(F.size(found) == 0, F.array(F.lit("El proyecto está en buen estado general"))).otherwise(found)


def _shape(name: Column) -> Column:
    """Length of a name and of what follows its last dot, as one number: equal names have equal shapes, and there are few."""
    return F.length(name) * 100_000 + F.length(F.substring_index(name, ".", -1))


def _pieces(text: Column, shapes: Column) -> Column:
    """Every distinct substring of one of ``shapes``; names are short, so containment becomes an equality join."""
    lengths = F.filter(F.array_distinct(F.transform(shapes, lambda s: F.floor(s / 100_000).cast("int"))), lambda n: (n > 0) & (n <= F.length(text)))
    some = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))))
    return F.array_distinct(F.filter(some, lambda p: F.array_contains(shapes, _shape(p))))


def _with_shapes(df: DataFrame, names: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_shapes", names.agg(F.collect_set(_shape(F.col(name)))).scalar())


def related_files(sources: DataFrame, others: DataFrame) -> DataFrame:
    """``(path, related, relation, confidence)`` for Rust ``sources(path, content)`` among ``others(path)``.

    Imports resolve to module files, tests lie under ``tests/`` and share the stem, guides lie beside the source, and every
    source depends on the manifest at the root, if there is one. For each source the surest relations come first.
    """
    src = sources.filter(tx.extension(F.col("path")) == "rs").select("path", "content")
    known = others.select(F.col("path").alias("related")).unionByName(sources.select(F.col("path").alias("related"))).distinct()

    modules = F.array_distinct(F.regexp_extract_all("content", F.lit(r"use\s+(crate::[a-zA-Z0-9_:]+)"), F.lit(1)))
    used = unnest(src, ["path"], modules, "module")
    base = F.concat(F.lit("src/"), F.replace(F.substr("module", F.lit(8)), F.lit("::"), F.lit("/")))
    used = used.select("path", F.explode(F.array(F.struct(F.lit(0).alias("order"), F.concat(base, F.lit(".rs")).alias("related")),
                                                F.struct(F.lit(1).alias("order"), F.concat(base, F.lit("/mod.rs")).alias("related")))).alias("t"), "module").select("path", "module", "t.*")
    imports = used.hint("merge").join(known, "related").groupBy("path", "module").agg(F.min_by("related", "order").alias("related"))

    tests = known.filter(F.startswith("related", F.lit("tests/"))).select("related", tx.file_name(F.col("related")).alias("name"))
    stems = src.select("path", tx.file_stem(F.col("path")).alias("stem"))
    # The pieces are many more rows than the optimizer takes them for, and must not be broadcast.
    held = unnest(_with_shapes(tests, stems, "stem"), ["related"], _pieces(F.col("name"), F.col("_shapes")), "stem")
    by_stem = held.hint("merge").join(stems, "stem").select("path", "related")
    patterns = F.array(*[F.concat(F.lit(a), F.col("stem"), F.lit(b)) for a, b in (("", "_test.rs"), ("test_", ".rs"), ("", "_tests.rs"), ("tests/", ".rs"))])
    held = unnest(_with_shapes(stems, tests, "name"), ["path"], F.array_distinct(F.flatten(F.transform(patterns, lambda p: _pieces(p, F.col("_shapes"))))), "name")
    by_pattern = held.hint("merge").join(tests, "name").select("path", "related")

    guides = known.filter(tx.file_name(F.col("related")) == "README.md").select("related", tx.parent_dir(F.col("related")).alias("dir"))
    beside = src.select("path", tx.parent_dir(F.col("path")).alias("dir")).join(small_or_shuffled(guides, "guides"), "dir").select("path", "related")

    there = known.filter(F.col("related") == "Cargo.toml").agg(F.count("*")).scalar() > 0
    manifest = src.filter(there).select("path", F.lit("Cargo.toml").alias("related"))

    def tagged(df, relation, confidence):
        return df.select("path", "related", F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))

    found = tagged(imports, "import", 0.8).unionByName(tagged(by_stem.unionByName(by_pattern).distinct(), "test", 0.85))
    found = found.unionByName(tagged(beside, "documentation", 0.7)).unionByName(tagged(manifest.select("path", "related"), "dependency", 0.6))
    return found.repartition("path").sortWithinPartitions("path", F.desc("confidence"), "related")


def fit_budget(sections: DataFrame, key: str, order: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """Sections that stay within a token budget: ``rank`` 0 goes first, then 1, each from the front, 2 always stays."""
    totals = sections.groupBy(key).agg(F.sum(tokens).alias("_all"))
    droppable = F.when(F.col(rank) < 2, F.col(tokens)).otherwise(0)
    bucket = F.col(rank) * 10**9 + F.floor(F.col(order) / 256)
    run = running_sum(sections, [key], [rank, order], bucket, droppable, "_run").join(totals, key)
    dropped = (F.col(rank) < 2) & (F.col("_all") - (F.col("_run") - F.col(tokens)) > budget)
    return run.filter(~dropped).drop("_run", "_all")
