"""Services of a source tree: where their roots are, what they are, and by which names others call them.

Everything follows from the paths of manifests and the texts of a few of them. Folders with a manifest are one row each;
what a folder is depends on its parent, its own manifests and the number of its build folders, which are joins and counts
on folder names, so a tree of any size is one aggregation by folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.paths import service_aliases
from knowmill.functions.text import maven_aggregator, maven_dependencies, maven_id, package_dependencies, submodule_paths

# Manifests in order of precedence with their languages, folders of shared libraries, conventional build
# folders, skipped folders, and packages that make a front end.
MANIFESTS = {"pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "package.json": "typescript", "go.mod": "go", "pyproject.toml": "python", "Cargo.toml": "rust"}
SHARED = ("shared", "libs", "libraries")
BUILD = ("project", "app", "server", "service", "backend", "src", "main")
SKIPPED = (".git", "node_modules", "target", "__pycache__")
FRONT = ("vue", "react", "react-dom", "@angular/core", "svelte", "@sveltejs/kit", "next", "nuxt", "@builder.io/qwik", "solid-js")


def shared_folder(name: Column) -> Column:
    return name.isin(*SHARED) | name.endswith("-shared")


def folders(files: DataFrame) -> DataFrame:
    """A row for each folder with a manifest: its manifests and language in order of precedence, its pom and package texts."""
    name = F.substring_index("path", "/", -1)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(MANIFESTS) for x in (k, i)]), name)
    language = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), name)
    m = files.where(F.col("path").contains("/") & name.isin(*MANIFESTS)).select(F.regexp_replace("path", "/[^/]+$", "").alias("root"), name.alias("manifest"), rank.alias("rank"), language.alias("language"), "content")
    text = lambda k: F.coalesce(F.max(F.when(F.col("manifest") == k, F.col("content"))), F.lit(""))
    g = m.groupBy("root").agg(F.array_sort(F.collect_set(F.struct("rank", "manifest"))).alias("all"), F.min_by("language", "rank").alias("language"), text("pom.xml").alias("pom"), text("package.json").alias("package"))
    parts = F.split("root", "/")
    return g.select("root", F.size(parts).alias("depth"), F.get(parts, 0).alias("top"), F.element_at(parts, -1).alias("id"), F.transform("all", lambda x: x["manifest"]).alias("manifests"), "language", "pom", "package")


def services(files: DataFrame, gitmodules: DataFrame | None = None) -> DataFrame:
    """(id, root, aliases, kind, identity_source, language, manifests) in order of id.

    Roots are the submodules' folders (``gitmodules`` has their content), and folders at the top with a manifest. A
    container of shared libraries without one, or with an aggregating pom, stands for its children. A folder at the top
    without a manifest is a root if exactly one of its conventional build folders has one. Only folders with manifests count.
    """
    d = folders(files)
    visible = lambda c: ~F.col(c).startswith(".") & (F.col(c) != "node_modules")
    tops = d.where((F.col("depth") == 1) & visible("id"))
    container, aggregate = shared_folder(F.col("top")), (F.col("pom") != "") & maven_aggregator("pom")
    own = tops.where(~(container & aggregate))
    closed = own.select("top")  # folders that do not stand for their children
    second = d.where((F.col("depth") == 2) & visible("top"))
    children = second.where(container & ~F.col("id").startswith(".")).join(closed, "top", "left_anti")
    built = second.where(~container & F.col("id").isin(*BUILD)).join(tops.select("top"), "top", "left_anti")
    one = built.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.first("manifests").alias("manifests"), F.first("language").alias("language"), F.first("pom").alias("pom")).where("n = 1")
    columns = ("root", "top", "id", "manifests", "language", "pom", "package")
    found = own.select(*columns).unionByName(children.select(*columns)).withColumn("nested", F.lit(False)).withColumn("source", F.lit("dir-name"))
    found = found.unionByName(one.select(F.col("top").alias("root"), "top", F.col("top").alias("id"), "manifests", "language", "pom", F.lit("").alias("package"), F.lit(True).alias("nested"), F.lit("dir-name").alias("source")))
    if gitmodules is not None:
        named = gitmodules.select(F.explode(submodule_paths("content")).alias("root")).distinct()
        sub = d.join(named, "root").select(*columns, F.lit(False).alias("nested"), F.lit("submodule").alias("source"))
        found = sub.unionByName(found.join(sub.select("root"), "root", "left_anti"))
    artifact = maven_id("pom")
    library = (F.col("pom") != "") & (maven_id("pom", "groupId").endswith(".shared") | (F.col("root").contains("/") & container))
    front = F.arrays_overlap(package_dependencies("package"), F.array(*[F.lit(x) for x in FRONT]))
    kind = F.when(F.col("nested"), "service").when(library, "library").when(F.coalesce(front, F.lit(False)), "frontend").otherwise("service")
    extra = F.when((artifact != "") & (artifact != F.col("id")), F.array(artifact)).otherwise(F.array().cast("array<string>"))
    return found.select("id", "root", F.concat(service_aliases("id"), extra).alias("aliases"), kind.alias("kind"), F.col("source").alias("identity_source"), "language", "manifests").orderBy("id")


def service_poms(files: DataFrame, services_: DataFrame) -> DataFrame:
    """(service_id, pom_path, content): the pom at a service's root, or else in its one build folder."""
    p = files.where(F.substring_index("path", "/", -1) == "pom.xml").select(F.col("path").alias("pom_path"), "content", F.regexp_replace("path", "/[^/]+$", "").alias("folder"))
    s = services_.select(F.col("id").alias("service_id"), "root")
    at = s.select("service_id", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.concat_ws("/", "root", *([F.lit(b)] if b else [])).alias("folder")) for i, b in enumerate(("", *BUILD))])).alias("x")).select("service_id", "x.*")
    return at.join(p, "folder").groupBy("service_id").agg(F.min_by(F.struct("pom_path", "content"), "rank").alias("x")).select("service_id", "x.*")


def library_deps(files: DataFrame, services_: DataFrame) -> DataFrame:
    """(service_id, library_id, pom_path): artifacts in a service's pom that are a library's id or one of its aliases."""
    lib = services_.where("kind = 'library'").select(F.col("id").alias("library_id"), F.explode(F.array_union(F.array("id"), F.col("aliases"))).alias("artifact")).distinct()
    needs = service_poms(files, services_).select("service_id", "pom_path", F.explode(F.array_distinct(maven_dependencies("content"))).alias("artifact"))
    return needs.join(lib, "artifact").select("service_id", "library_id", "pom_path").distinct()
