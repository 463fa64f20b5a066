"""Names to what they mean: imports to files by ranked candidates, re-exports by a bounded closure, references by a ladder of unique matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut, cut_table
from .joins import spread

# Source roots of Java projects, the first that a path has counts; files that stand for their folder.
JAVA_ROOTS = ["/src/main/java/", "/src/test/java/", "/src/", "/java/"]
FOLDER_FILES = ["mod", "index", "__init__"]
# What a TypeScript file may be that is imported under its compiled name.
COMPILED = ["js", "jsx"]
TYPED = ["ts", "tsx", "mts", "cts"]
#: Kinds of symbols that can be called; classes of scripts count as structs.
CALLABLE = ("function", "method", "class", "struct")
#: Modules of these share no global names, and a member of something else is no name of theirs.
SCRIPTS = ("javascript", "typescript", "swift")


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normalised(path: Column) -> Column:
    """path without empty and "." segments; ".." takes the segment before it away."""
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))), "/")


def candidates(base: Column, extensions: list[str], compiled: bool = False) -> Column:
    """Paths that an import of base may mean, the likeliest first: itself, then, if it has no known ending, with each ending and as a folder.

    compiled: after a path with a JavaScript ending come those of the TypeScript files it may be made from.
    """
    known = F.lower(base).rlike(f"[^/][.]({'|'.join(extensions)})$")
    more = [F.concat(base, F.lit(x)) for e in extensions for x in (f".{e}", *[f"/{name}.{e}" for name in FOLDER_FILES])]
    out = F.when(known, F.array(base)).otherwise(F.array(base, *more))
    if compiled:
        stem = lambda p: F.regexp_replace(p, "[.][^./]*$", "")
        forms = lambda p: F.when(p.rlike(f"[.]({'|'.join(COMPILED)})$"), F.array(p, *[F.concat(stem(p), F.lit(f".{e}")) for e in TYPED])).otherwise(F.array(p))
        out = F.when(base.rlike(f"[.]({'|'.join(COMPILED)})$"), F.flatten(F.transform(out, forms))).otherwise(out)
    return F.array_distinct(out)


def first_existing(wanted: DataFrame, files: DataFrame, fold: Column | None = None) -> DataFrame:
    """(key, path, rank): for each of wanted(key, candidates) the first candidate, from 0, that is one of files(path).

    Where fold holds (a column of wanted), a candidate also stands for the one file that is equal to it but for the case of letters;
    where several are, for none. A path that very many import is copied to several tasks.
    """
    paths = files.select("path").distinct()
    c = cut_table(wanted.select("key", (fold if fold is not None else F.lit(False)).alias("fold"), F.posexplode("candidates").alias("rank", "candidate")))
    found = spread(c, paths.select(F.col("path").alias("candidate"), "path"), "candidate").select("key", "rank", F.lit(0).alias("way"), "path")
    if fold is not None:
        folded = paths.groupBy(F.lower("path").alias("low")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
        lower = cut_table(c.where("fold").withColumn("low", F.lower("candidate")))
        found = found.unionByName(spread(lower, folded, "low").select("key", "rank", F.lit(1).alias("way"), "path"))
    return found.groupBy("key").agg(F.min(F.struct("rank", "way", "path")).alias("m")).select("key", "m.path", F.col("m.rank").cast("long").alias("rank"))


def package_files(wanted: DataFrame, files: DataFrame, label: str, extension: str = "go") -> DataFrame:
    """(key, path): the source files of the folder that each of wanted(key, target) names after the segment label; subfolders are other packages."""
    parts = F.split("target", "/")
    at = F.array_position(parts, F.lit(label))
    w = wanted.where(at > 0).select("key", F.array_join(F.slice(parts, at + 1, F.size(parts)), "/").alias("folder")).where("folder <> ''")
    return w.join(files.where(F.col("path").endswith(f".{extension}")).select(folder(F.col("path")).alias("folder"), "path").distinct(), "folder").select("key", "path")


def longest_suffix(wanted: DataFrame, files: DataFrame, extension: str = "java") -> DataFrame:
    """(key, path): the file whose place under its source root is the longest beginning of wanted(key, target), a dotted name; of equal places the last path."""
    p = F.col("path")
    root = reduce(lambda c, m: c.when(F.contains(p, F.lit(m)), F.substring_index(p, m, -1)), JAVA_ROOTS, F.when(F.lit(False), p)).otherwise(p)
    index = files.where(p.endswith(f".{extension}")).groupBy(root.alias("place")).agg(F.max("path").alias("path"))
    parts = F.filter(F.split("target", "[.]"), lambda x: (x != "") & (x != "*"))
    w = wanted.select("key", parts.alias("parts")).where(F.size("parts") > 0)
    w = w.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("k"), F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit(f".{extension}")).alias("place")))).alias("x")).select("key", "x.*")
    return spread(cut_table(w), index, "place").groupBy("key").agg(F.max_by("path", "k").alias("path"))


def forwarded(entries: DataFrame, forwards: DataFrame, depth: int = 4, most: int = 16) -> DataFrame:
    """(key, path, place): what each of entries(key, path) reaches along forwards(path, pos, to), in the order it is met, from 1.

    Level by level, each in the order of the level before and of pos, ties by to; a file is met once, the entry itself never. A key goes
    no deeper once it has most files; the first most are given. So no key holds more than most rows and one level's.
    """
    f = cut(forwards.groupBy("path", "to").agg(F.min("pos").alias("pos")))
    front = cut(entries.select("key", "path", F.lit(0).alias("place")).distinct())
    seen, out = front.select("key", "path"), None
    for _ in range(depth):
        met = front.join(f, "path").groupBy("key", F.col("to").alias("path")).agg(F.min(F.struct("place", "pos", F.col("to").alias("t"))).alias("o")).join(seen, ["key", "path"], "left_anti")
        base = seen.groupBy("key").agg((F.count("*") - 1).alias("had"))
        by = Window.partitionBy("key").orderBy("o")
        # Rows beyond the limit would be neither given nor followed, as the key stops there.
        new = cut(met.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).join(base, "key").withColumn("place", (F.col("had") + F.col("r")).cast("int")).where(F.col("place") <= most).select("key", "path", "place"))
        if new.isEmpty():
            break
        out = new if out is None else out.unionByName(new)
        seen = cut(seen.unionByName(new.select("key", "path")))
        full = new.where(F.col("place") >= most).select("key")
        front = cut(new.join(full, "key", "left_anti"))
    return out if out is not None else front.limit(0)


#: A name that more files define, or a file that imports more, is not listed in one row; imports of all files that are listed.
LIST, LISTED = 256, 500_000


def _definitions(symbols: DataFrame) -> DataFrame:
    """(path, name, any, call, method): the one symbol of a file's name, the one that a call may mean, and the one method; null where there are several."""
    callable_, method = F.col("kind").isin(*CALLABLE), F.col("kind") == "method"
    g = symbols.groupBy("path", "name").agg(
        F.count("*").alias("n"), F.min("id").alias("id"), F.count_if(callable_).alias("m"), F.min(F.when(callable_, F.col("id"))).alias("c"), F.count_if(method).alias("k"), F.min(F.when(method, F.col("id"))).alias("method")
    )
    only = F.when(F.col("n") == 1, F.col("id"))
    return g.select("path", "name", only.alias("any"), F.coalesce(only, F.when(F.col("m") == 1, F.col("c"))).alias("call"), F.when(F.col("k") == 1, F.col("method")).alias("method"))


def _bound(bindings: DataFrame, defined: DataFrame) -> DataFrame:
    """(path, name, direct, through): what a file's name is bound to, directly and through re-exports, for uses (any) and for calls (call).

    Each is the least and the greatest target and whether there are more. Rows meet in tasks before they are exchanged: bits of hashes that
    neither of the two has show that there are more; where none does, targets are counted.
    """
    keys, there = ["path", "name", "forwarded"], defined.select(F.col("path").alias("target_path"), F.col("name").alias("imported"), "any", "call")
    b = bindings.select("path", F.col("local").alias("name"), "target_path", "imported", "forwarded").where("forwarded is not null")
    hashed = lambda x: F.xxhash64(F.col(x))
    bits = lambda x: F.when(F.col(x).isNotNull(), hashed(x))
    some = [f(x).alias(f"{x}_{n}") for x in ("any", "call") for n, f in (("low", F.min), ("high", F.max), ("n", F.count), ("or", lambda x: F.bit_or(bits(x))), ("and", lambda x: F.bit_and(bits(x))))]
    g = cut_table(b.join(there, ["target_path", "imported"]).where("any is not null or call is not null").groupBy(*keys).agg(*some))
    shown = lambda x: (F.col(f"{x}_or") != hashed(f"{x}_low").bitwiseOR(hashed(f"{x}_high"))) | (F.col(f"{x}_and") != hashed(f"{x}_low").bitwiseAND(hashed(f"{x}_high")))
    open_ = lambda x: (F.col(f"{x}_n") > 2) & (F.col(f"{x}_low") != F.col(f"{x}_high")) & ~shown(x)
    more = {x: F.coalesce(shown(x), F.lit(False)) for x in ("any", "call")}
    asked = cut_table(g.where(open_("any") | open_("call")).select(*keys))
    if not asked.isEmpty():
        counted = b.join(asked, keys, "left_semi").join(there, ["target_path", "imported"]).groupBy(*keys).agg(*[(F.count_distinct(x) > 2).alias(f"{x}_more") for x in more])
        g = g.join(cut_table(counted), keys, "left")
        more = {x: F.coalesce(f"{x}_more", c) for x, c in more.items()}
    g = g.select(*keys, F.struct(*[F.struct(F.col(f"{x}_low").alias("low"), F.col(f"{x}_high").alias("high"), c.alias("more")).alias(x) for x, c in more.items()]).alias("to"))
    return cut_table(g.groupBy("path", "name").agg(F.max(F.when(~F.col("forwarded"), F.col("to"))).alias("direct"), F.max(F.when(F.col("forwarded"), F.col("to"))).alias("through")))


def _unlisted(refs: DataFrame, defined: DataFrame, imports: DataFrame, common: DataFrame, far: DataFrame) -> DataFrame:
    """(path, name, own, seen) of the names that refs ask for and that many files define, or in files that import many: row by row.

    Each goes the way that has fewer rows: through the files that its file imports, or those that define the name. own is the file's
    definition; seen, for uses (any) and calls (call), the number of targets in imported files, the least and the greatest.
    """
    asked = refs.select("path", "name").where("path is not null and name is not null").distinct()
    asked = cut_table(asked.join(common, "name", "left_semi").unionByName(asked.join(far, "path", "left_semi")).distinct())
    sized = asked.join(defined.groupBy("name").agg(F.count("*").alias("files")), "name").join(imports.groupBy("path").agg(F.count("*").alias("paths")), "path")
    sized, defining = cut_table(sized), defined.select(F.col("path").alias("target_path"), "name", "any", "call")
    seen = sized.where("paths <= files").join(imports, "path").join(defining, ["target_path", "name"])
    seen = seen.unionByName(sized.where("paths > files").join(defining, "name").join(imports, ["path", "target_path"]))
    seen = seen.groupBy("path", "name").agg(F.struct(*[F.struct(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).alias(x) for x in ("any", "call")]).alias("seen"))
    own = asked.join(defined, ["path", "name"]).select("path", "name", F.struct("path", "any", "call", "method").alias("own"))
    return cut_table(asked.join(own, ["path", "name"], "left").join(seen, ["path", "name"], "left").withColumn("unlisted", F.lit(True)))


def resolve_references(refs: DataFrame, symbols: DataFrame, bindings: DataFrame, imported: DataFrame) -> DataFrame:
    """(ref, target, stage) for each of refs(ref, path, name, language, kind, source, qualified, receiver); ref is unique.

    The first stage that has one target takes it:
    * own_file: the file itself defines the name once (a call may also mean the one callable of it); no use of itself but by a call.
    * import_binding: the file binds the name to a name of another file, defined there once; bindings(path, local, target_path,
      imported, forwarded): direct ones go before those through re-exports, and several targets of either kind end the stage.
    * imported_file: of the files that imported(path, target_path) has for the file, one defines the name.
    * repository: one symbol of the language has the name; not for scripts.
    Qualified names of scripts mean nothing here; in Rust, after `self`, the file's one method of that name (self_method), else nothing.
    What is left has a null target and the stage unresolved or refused. symbols(id, path, name, kind, language).

    refs are not written, and exchanged once, by name: a name's row lists the files that define it, so all stages are told in place.
    """
    script, rust = F.col("language").isin(*SCRIPTS), F.col("language") == "rust"
    qualified = F.coalesce("qualified", F.lit(False))
    way = F.when(qualified & (script | rust), F.when(rust & (F.col("receiver") == "self"), "method").otherwise("refused")).when(F.col("kind") == "calls", "calls").otherwise("uses")
    r = refs.select("ref", "path", "name", "language", "source", way.alias("way"))

    defined = cut_table(_definitions(symbols))
    common = cut_table(defined.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > LIST).select("name"))
    files = defined.join(common, "name", "left_anti").groupBy("name").agg(F.collect_list(F.struct("path", "any", "call", "method")).alias("files"))
    whole = symbols.groupBy("language", "name").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n <= 2")
    whole = whole.groupBy("name").agg(F.collect_list(F.struct("language", "n", "low", "high")).alias("whole"))
    names = cut_table(files.join(whole, "name", "full"))

    imports = cut_table(imported.select("path", "target_path").where("path is not null and target_path is not null").distinct())
    few = imports.groupBy("path").agg(F.count("*").alias("n")).where((F.col("n") <= LIST) & F.lit(imports.count() <= LISTED)).select("path")
    lists = cut_table(imports.join(few, "path", "left_semi").groupBy("path").agg(F.collect_list("target_path").alias("paths")))
    far = cut_table(imports.join(lists, "path", "left_anti").select("path").distinct())

    calls, plain, unlisted = F.col("way") == "calls", F.col("way").isin("calls", "uses"), F.col("unlisted").isNotNull()
    picked = lambda x: F.when(calls, x["call"]).otherwise(x["any"])
    mine = lambda x: x.eqNullSafe(F.col("source"))

    # A reference's own source is no target; of what else there is, one is the target.
    others = lambda x: x["low"].isNotNull() & ((x["low"] != x["high"]) | ~mine(x["low"]))
    one = lambda x: F.when(x["low"] == x["high"], x["low"]).when(~x["more"] & mine(x["low"]), x["high"]).when(~x["more"] & mine(x["high"]), x["low"])
    r = r.join(_bound(bindings, defined), ["path", "name"], "left").withColumn("direct", picked(F.col("direct"))).withColumn("through", picked(F.col("through")))
    bound = F.when(others(F.col("direct")), one(F.col("direct"))).when(others(F.col("through")), one(F.col("through")))
    r = r.withColumn("bound", bound).drop("direct", "through")

    if common.isEmpty() and far.isEmpty():
        r = r.withColumn("own", F.lit(None).cast("struct<path:string,any:string,call:string,method:string>")).withColumn("seen", F.lit(None).cast("struct<any:struct<n:long,low:string,high:string>,call:struct<n:long,low:string,high:string>>")).withColumn("unlisted", F.lit(None).cast("boolean"))
    else:
        r = r.join(_unlisted(refs, defined, imports, common, far), ["path", "name"], "left")
    r = r.join(names, "name", "left").join(F.broadcast(lists), "path", "left")  # LISTED paths at most

    listed = F.get(F.filter("files", lambda x: x["path"] == F.col("path")), F.lit(0))
    r = r.withColumn("own", F.when(unlisted, F.col("own")).otherwise(listed)).withColumn("own_target", picked(F.col("own")))
    r = r.withColumn("own_file", F.when(calls | ~mine(F.col("own_target")), F.col("own_target")))

    # A symbol has one file, so targets of several files differ.
    r = r.withColumn("files", F.filter(F.transform("files", lambda x: F.struct(x["path"].alias("path"), picked(x).alias("target"))), lambda x: x["target"].isNotNull() & ~mine(x["target"])))
    r = r.withColumn("paths", F.array_intersect("files.path", "paths")).withColumn("seen", picked(F.col("seen"))).withColumn("first", F.get("paths", F.lit(0)))
    n, low, high = (F.col(f"seen.{x}") for x in ("n", "low", "high"))
    rows = F.when((n == 1) & ~mine(low), low).when((n == 2) & mine(low), high).when((n == 2) & mine(high), low)
    in_lists = F.when(F.size("paths") == 1, F.get(F.filter("files", lambda x: x["path"] == F.col("first")), F.lit(0))["target"])
    r = r.withColumn("by_file", F.when(unlisted, rows).otherwise(in_lists))

    r = r.withColumn("whole", F.when(~script, F.get(F.filter("whole", lambda x: x["language"] == F.col("language")), F.lit(0))))
    n, low, high = (F.col(f"whole.{x}") for x in ("n", "low", "high"))
    r = r.withColumn("unique", F.when((n == 1) & (calls | ~mine(low)), low).when((n == 2) & ~calls & mine(low), high).when((n == 2) & ~calls & mine(high), low))

    stages = {"own_file": "own_file", "bound": "import_binding", "by_file": "imported_file", "unique": "repository"}
    target = F.when(plain, F.coalesce(*stages)).when(F.col("way") == "method", F.col("own.method"))
    stage = reduce(lambda c, x: c.when(plain & F.col(x[0]).isNotNull(), x[1]), stages.items(), F.when(F.col("way") == "refused", "refused")).when(plain, "unresolved")
    return r.select("ref", target.alias("target"), stage.when(F.col("own.method").isNull(), "refused").otherwise("self_method").alias("stage"))
