"""Static security findings, execution signals, and coverage by file and domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sourcelake.functions import paths
from sourcelake.functions.parse import SUBPROCESS
from sourcelake.functions.yaml_tree import lines_in_scalars, yaml_signals
from sourcelake.functions.secrets import located_in

# They must equal those of the contract.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
DOMAINS = ["secrets", "dangerous_primitives", "configuration", "execution_surface", "bounded_dataflow"]
MAX_PER_FILE = 2000
NETWORK_WORDS = ["http", "https", "request", "fetch", "axios", "urllib", "ssl", "tls", "session", "client"]
TLS_OFF_WHEN_FALSE = ["verify", "verifyssl", "verifytls", "checkhostname", "rejectunauthorized"]
TLS_OFF_WHEN_TRUE = ["insecure", "ignorehttperrors", "dangeracceptinvalidcerts", "dangeracceptinvalidhostnames"]
CORS_LANGUAGES = ["javascript", "typescript", "python", "php", "json", "yaml"]
PROCESS_MODULE, PROCESS_CALLS, PROCESS_CALLS_WITH_OPTION = "child_process", ["exec", "execSync"], ["spawn", "spawnSync", "execFile", "execFileSync"]
KINDS = {"secret.": "secret", "config-": "configuration"}
CONFIDENCES = {"config-world-writable-mode": "medium", "config-wildcard-cors": "medium"}
SIGNAL_OF_RULE = {"dangerous-eval": "dynamic_evaluation_primitive", "dangerous-process-execution": "process_execution_primitive", "dangerous-deserialization": "deserialization_primitive"}


def fingerprint(rule, path, *what):
    """Equal for equal findings; every part is preceded by its length."""
    parts = [F.lit("finding"), rule, path, *what]
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in [x.cast("string") for x in parts]]).cast("binary"), 256)


def secret_findings(files: DataFrame, counted: bool = False) -> DataFrame:
    """One row per detected secret: its line, and a fingerprint by value, which moving lines leave alone."""
    rows = files.select("relative_path", F.explode(located_in(F.col("content"), counted)).alias("s")).select("relative_path", "s.*")
    return rows.select("rule_id", F.lit("high").alias("severity"), "relative_path", "line", "column", fingerprint(F.col("rule_id"), F.col("relative_path"), F.col("value_hash")).alias("fingerprint"), F.lit("[REDACTED]").alias("preview"))


def primitive_findings(parsed: DataFrame) -> DataFrame:
    """Dangerous calls; (relative_path, language, parsed). Names are resolved through the file's imports first."""
    calls = parsed.select("relative_path", "language", F.col("parsed.imports").alias("imports"), F.explode("parsed.calls").alias("c"))
    head = F.substring_index("c.callee", ".", 1)
    found = F.get(F.filter("imports", lambda i: i.local_name == head), F.lit(0))
    rest = F.regexp_replace("c.callee", r"^[^.]*", "")
    # a default import of a module is the module
    module, what = F.regexp_replace(found["module"], "^node:", ""), F.when(found["imported_name"] != "default", found["imported_name"])
    name = F.when(found.isNull(), F.col("c.callee")).otherwise(F.concat(module, F.when(what.isNotNull(), F.concat(F.lit("."), what)).otherwise(""), rest))
    rows = calls.withColumn("name", name)
    n, lang = F.col("name"), F.col("language")
    js = lang.isin("javascript", "typescript")
    evaluates = ((lang == "python") & n.isin("eval", "exec", "builtins.eval", "builtins.exec")) | (js & n.isin("eval", "globalThis.eval", "window.eval", "Function")) | ((lang == "php") & (n == "eval"))
    runs = ((lang == "python") & n.isin(*[f"subprocess.{x}" for x in sorted(SUBPROCESS)]) & F.coalesce("c.shell", F.lit(False))) | (js & n.isin(*[f"{PROCESS_MODULE}.{x}" for x in PROCESS_CALLS])) | (js & n.isin(*[f"{PROCESS_MODULE}.{x}" for x in PROCESS_CALLS_WITH_OPTION]) & F.coalesce("c.shell", F.lit(False))) | ((lang == "php") & n.isin("exec", "shell_exec", "system", "passthru", "popen", "proc_open"))
    loads = ((lang == "python") & n.isin("pickle.load", "pickle.loads")) | ((lang == "php") & (n == "unserialize"))
    rule = F.when(evaluates, "dangerous-eval").when(runs, "dangerous-process-execution").when(loads, "dangerous-deserialization")
    return rows.withColumn("rule_id", rule).where("rule_id is not null").select("rule_id", F.lit("medium").alias("severity"), "relative_path", F.col("c.line").alias("line"), F.col("c.column").alias("column"))


def literal_options(parsed: DataFrame) -> DataFrame:
    """(relative_path, line, callee, name, value) of every literal boolean option of a call; (relative_path, parsed)."""
    calls = parsed.select("relative_path", F.explode("parsed.calls").alias("c"))
    return calls.select("relative_path", "c.line", "c.callee", F.explode("c.options").alias("o")).select("relative_path", "line", "callee", "o.name", "o.value")


def configuration_findings(files: DataFrame) -> DataFrame:
    """Findings of single lines and of unpinned workflow actions; the first rule that fits a line wins, and comment lines and the texts of block scalars count for none."""
    name = paths.file_name(F.col("relative_path"))
    docker = (name == "Dockerfile") | name.startswith("Dockerfile.")
    language = paths.language(F.col("relative_path"))
    hint = F.col("content").rlike("(?i)chmod|USER|Access-Control-Allow-Origin")
    some = files.where(hint).select("relative_path", "content", docker.alias("docker"), language.alias("language"))
    # only YAML files have block scalars, and only they go to Python
    plain = some.where("language <> 'yaml'").withColumn("hidden", F.array().cast("array<long>"))
    some = plain.unionByName(some.where("language = 'yaml'").withColumn("hidden", lines_in_scalars("content")))
    lines = some.select("relative_path", "docker", "language", "hidden", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    t = F.ltrim("text")
    root = F.col("docker") & t.rlike(r"^(?i:USER)\s+(?:root|[+-]?0+)(?:[:\s]|$)")
    writable = (F.col("docker") | (F.col("language") == "shell")) & t.rlike(r"\bchmod\s+(?:-R\s+)?0?777\b")
    cors = F.col("language").isin(CORS_LANGUAGES) & t.rlike(r"(?i)Access-Control-Allow-Origin[\"']?\s*[:,=]\s*[\"']?\*")
    rule = F.when(root, "config-docker-root-user").when(writable, "config-world-writable-mode").when(cors, "config-wildcard-cors")
    line = (F.col("at") + 1).cast("long")
    out = lines.where(~t.startswith("#") & ~t.startswith("//") & ~F.array_contains("hidden", line)).withColumn("rule_id", rule).where("rule_id is not null")
    out = out.select("rule_id", "relative_path", line.alias("line"))
    actions = yaml_signals(files).select("relative_path", F.explode("signals").alias("s")).where("s.kind = 'github_workflow_mutable_ref'")
    out = out.unionByName(actions.select(F.lit("config-unpinned-github-action").alias("rule_id"), "relative_path", "s.line"))
    low = F.col("rule_id").isin("config-docker-root-user", "config-wildcard-cors")
    return out.select("rule_id", F.when(low, "low").otherwise("medium").alias("severity"), "relative_path", "line")


def environment_findings(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """``.env`` files, by whether Git tracks them; templates are none."""
    name = paths.file_name(F.col("relative_path"))
    rows = files.where(((name == ".env") | name.startswith(".env.")) & ~name.rlike(r"\.(example|sample|template)$")).select("relative_path").join(tracked.select("relative_path", F.lit(True).alias("t")).distinct(), "relative_path", "left")
    return rows.select(F.when(F.col("t").isNotNull(), "config-tracked-env").otherwise("config-env-file").alias("rule_id"), F.when(F.col("t").isNotNull(), "medium").otherwise("low").alias("severity"), "relative_path", F.lit(1).cast("long").alias("line"))


def execution_signals(files: DataFrame, primitives: DataFrame) -> DataFrame:
    """Location-only signals: Docker entry points, build scripts, package scripts, and dangerous primitives."""
    name = paths.file_name(F.col("relative_path"))
    docker = files.where((name == "Dockerfile") | name.startswith("Dockerfile.")).select("relative_path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    word = F.upper(F.regexp_extract(F.ltrim("text"), r"^(\w+)\s", 1))
    kind = F.when(word == "ENTRYPOINT", "docker_entrypoint").when(word == "CMD", "docker_command").when(F.ltrim("text").rlike(r"^(?i:USER)\s+(?:root|[+-]?0+)(?:[:\s]|$)"), "docker_root_user")
    out = docker.select(kind.alias("kind"), "relative_path", (F.col("at") + 1).cast("long").alias("line")).where("kind is not null")
    build = files.where(name == "build.rs").select(F.lit("cargo_build_script").alias("kind"), "relative_path", F.lit(1).cast("long").alias("line"))
    scripts = files.where(name.isin("package.json", "composer.json") & (F.get_json_object("content", "$.scripts").rlike(r"^\{.*:"))).select(F.when(name == "package.json", "package_script").otherwise("composer_script").alias("kind"), "relative_path", F.lit(1).cast("long").alias("line"))
    pairs = F.create_map(*[F.lit(x) for kv in SIGNAL_OF_RULE.items() for x in kv])
    prim = primitives.select(F.try_element_at(pairs, F.col("rule_id")).alias("kind"), "relative_path", "line").where("kind is not null")
    return out.unionByName(build).unionByName(scripts).unionByName(prim).distinct()


def tls_signals(options: DataFrame) -> DataFrame:
    """Calls with a literal option that turns TLS checks off, once each; (relative_path, line, callee, name, value)."""
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    off = F.when(F.col("value"), plain.isin(TLS_OFF_WHEN_TRUE)).otherwise(plain.isin(TLS_OFF_WHEN_FALSE))
    hit = options.where(F.lower("callee").rlike("|".join(NETWORK_WORDS)) & F.col("value").isNotNull() & off)
    return hit.select(F.lit("tls_verification_disabled").alias("kind"), "relative_path", "line").distinct()


def capped(findings: DataFrame, limit: int = MAX_PER_FILE) -> DataFrame:
    """At most ``limit`` findings a file, and whether the file had more: that domain is then partial."""
    w = Window.partitionBy("relative_path").orderBy("line", "rule_id")
    return findings.withColumn("place", F.row_number().over(w)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("relative_path"))).where(F.col("place") <= limit).withColumn("limited", F.col("all") > limit).drop("all")


def limited_report(findings: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` findings by path and place, the files and domains that lost some: (relative_path, domain)).

    Lost rows alone are looked at, so the report's cap costs a top-k and an anti join.
    """
    order = ["relative_path", "line", "column", "rule_id", "fingerprint"]
    kept = findings.orderBy(*order).limit(limit)
    lost = findings.join(kept.select(*order).distinct(), order, "left_anti")
    return kept, lost.select("relative_path", domain_of(F.col("rule_id")).alias("domain")).distinct()


def domain_of(rule_id):
    return F.when(rule_id.startswith("secret."), "secrets").when(rule_id.startswith("config-"), "configuration").otherwise("dangerous_primitives")


def described(findings: DataFrame) -> DataFrame:
    """``findings`` with the kind and the confidence that follow from their rules."""
    kind = F.lit("primitive")
    for prefix, value in KINDS.items():
        kind = F.when(F.col("rule_id").startswith(prefix), value).otherwise(kind)
    confidence = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCES.items() for x in kv]), F.col("rule_id")), F.lit("high"))
    return findings.withColumn("kind", kind).withColumn("confidence", confidence)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings")).withColumn("rank", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("long"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results with the index of their rule in the sorted list of rules; the list has a handful of rows."""
    rules = findings.select("rule_id").distinct()
    indexed = rules.withColumn("rule_index", (F.row_number().over(Window.orderBy("rule_id")) - 1).cast("long"))
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return findings.join(F.broadcast(indexed), "rule_id").select("rule_id", "rule_index", F.element_at(levels, F.col("severity")).alias("level"), paths.relative_uri(F.col("relative_path")).alias("uri"), "line")


#: Reasons of a domain's status, by what stopped it.
MAX_REASONS, MAX_REASON_BYTES = 32, 64


def file_coverage(inv: DataFrame, findings: DataFrame | dict[str, str], stopped: DataFrame | None = None, unread: DataFrame | None = None, ran: list[str] = DOMAINS) -> DataFrame:
    """Five rows a file: the status of each domain, its number of findings where it is complete (else null), and the reasons of another status.

    ``findings`` are rows of (relative_path, domain), of files with a path of their own each; where paths may repeat or be null, domains and
    the columns of ``inv`` with every file's own number of findings.
    ``stopped`` (relative_path, domain, and reason if it has one) tells where a parser or a limit left a domain partial; without it this
    takes every file as seen to its end. ``unread`` (relative_path) names files that could not be read: every domain of theirs is partial.
    Domains that no detector ``ran`` for are not reported.
    """
    domain = F.explode(F.array(*map(F.lit, DOMAINS)))
    if isinstance(findings, dict):
        own = inv.select("relative_path", "language", "binary", *findings.values(), domain.alias("domain"))
        rows = own.withColumn("n", F.coalesce(*[F.when(F.col("domain") == d, F.col(n)) for d, n in findings.items()], F.lit(0)))
    else:
        counts = findings.groupBy("relative_path", "domain").agg(F.count(F.lit(1)).alias("n"))
        rows = inv.select("relative_path", "language", "binary", domain.alias("domain")).join(counts, ["relative_path", "domain"], "left")
    needs_parser = F.col("domain").isin("dangerous_primitives", "bounded_dataflow")
    supported = F.when(F.col("domain") == "bounded_dataflow", F.col("language") == "python").otherwise(F.col("language").isin("php", "javascript", "typescript", "python"))
    status = F.when(F.col("binary"), "excluded").when(needs_parser & ~supported, "unsupported").otherwise("complete")
    own_reason = F.when(F.col("binary"), F.array(F.lit("binary_file"))).when(needs_parser & ~supported, F.array(F.lit("language_unsupported"))).otherwise(F.array().cast("array<string>"))
    joined = rows.withColumn("status", status).withColumn("reasons", own_reason).withColumn("read", F.lit(True))
    if stopped is not None:
        if "reason" not in stopped.columns:
            stopped = stopped.withColumn("reason", F.lit("limit"))
        reasons = stopped.groupBy("relative_path", "domain").agg(reason_union(F.collect_set("reason")).alias("stopped"))
        joined = joined.join(reasons, ["relative_path", "domain"], "left")
        hit = F.col("stopped").isNotNull() & (F.col("status") == "complete")
        joined = joined.withColumn("reasons", F.when(hit, F.col("stopped")).otherwise(F.col("reasons"))).withColumn("status", F.when(hit, "partial").otherwise(F.col("status")))
    if unread is not None:
        joined = joined.join(unread.select("relative_path").distinct().withColumn("lost", F.lit(True)), "relative_path", "left")
        lost = F.col("lost").isNotNull()
        joined = joined.withColumn("read", ~lost).withColumn("reasons", F.when(lost, F.array(F.lit("file_read_failed"))).otherwise(F.col("reasons"))).withColumn("status", F.when(lost, "partial").otherwise(F.col("status")))
    told = F.col("domain").isin(ran)
    joined = joined.withColumn("status", F.when(told, F.col("status")).otherwise("not_reported")).withColumn("read", told & F.col("read")).withColumn("reasons", F.when(told, F.col("reasons")).otherwise(F.array(F.lit("detector_not_run"))))
    complete = F.col("status") == "complete"
    return joined.select("relative_path", "domain", "status", F.lit(True).alias("selected"), "read", F.when(needs_parser, complete).alias("parsed"), complete.alias("evaluated"), F.when(complete, F.coalesce("n", F.lit(0))).cast("long").alias("finding_count"), "reasons")


def reason_union(reasons):
    """Distinct reasons in order, of at most ``MAX_REASON_BYTES`` bytes each and ``MAX_REASONS`` in number."""
    return F.slice(F.sort_array(F.array_distinct(F.filter(reasons, lambda r: F.octet_length(r) <= MAX_REASON_BYTES))), 1, MAX_REASONS)


def coverage_violations(coverage: DataFrame) -> DataFrame:
    """(relative_path, domain, rule) for every row that contradicts itself; a sound table gives none."""
    complete = F.col("status") == "complete"
    rules = {
        "evaluated_unread": F.col("evaluated") & ~F.col("read"),
        "read_unselected": F.col("read") & ~F.col("selected"),
        "complete_unevaluated": complete & ~F.col("evaluated"),
        "complete_unparsed": complete & (F.col("parsed") == F.lit(False)),
        "count_unless_complete": complete != F.col("finding_count").isNotNull(),
        "negative_count": F.coalesce(F.col("finding_count"), F.lit(0)) < 0,
        "unknown_status": ~F.col("status").isin("complete", "partial", "unsupported", "excluded", "not_reported"),
        "partial_without_reason": (F.col("status") == "partial") & (F.size("reasons") == 0),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    twice = coverage.groupBy("relative_path", "domain").count().where("count > 1").select("relative_path", "domain", F.lit("reported_twice").alias("rule"))
    return coverage.select("relative_path", "domain", F.explode(broken).alias("rule")).unionByName(twice)


def limited_files(coverage: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of the ``limit`` least paths, one row with the number of files omitted)."""
    files = coverage.select("relative_path").distinct()
    kept = files.orderBy("relative_path").limit(limit)
    return coverage.join(kept, "relative_path", "left_semi"), files.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).cast("long").alias("omitted"))


def domain_coverage(coverage: DataFrame) -> DataFrame:
    """Per domain the counts of each status, the status that follows from them, and a total that is null unless complete."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = coverage.groupBy("domain").agg(*[of(s) for s in ("complete", "partial", "unsupported", "excluded", "not_reported")], F.count_if("read").alias("read_files"), F.count_if("evaluated").alias("evaluated_files"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("found"))
    mixed = (F.col("partial") > 0) | ((F.col("complete") > 0) & (F.col("unsupported") > 0)) | ((F.col("not_reported") > 0) & (F.col("complete") + F.col("unsupported") + F.col("excluded") > 0))
    status = F.when(mixed, "partial").when(F.col("unsupported") > 0, "unsupported").when(F.col("complete") > 0, "complete").when((F.col("excluded") > 0) & (F.col("not_reported") == 0), "excluded").otherwise("not_reported")
    return rows.withColumn("status", status).withColumn("findings", F.when(F.col("status") == "complete", F.col("found"))).drop("found")


def required_gate(domains: DataFrame) -> DataFrame:
    """Whether all domains but the optional dataflow are complete, and passes if none of them found anything."""
    must = F.col("domain") != "bounded_dataflow"
    row = domains.agg(F.bool_and(~must | F.col("status").isin("complete", "excluded")).alias("complete"), F.coalesce(F.sum(F.when(must, F.col("findings"))), F.lit(0)).alias("findings"))
    return row.select("complete", F.when(F.col("complete"), F.col("findings")).alias("findings"), F.when(~F.col("complete"), 6).when(F.col("findings") > 0, 5).otherwise(0).cast("long").alias("exit_code"))
