"""Record sources: request trajectories, verdicts, question batteries, shell scripts, settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of battery questions, and the commands that read.
BATTERY_TYPES = ("comprehension", "structure", "trace", "locate", "detail/fix")
PATH_TOOLS, SEARCH_TOOLS, LIST_TOOLS = ("cat", "less", "head", "tail"), ("grep", "rg"), ("ls", "find")

BLOCK = "struct<type:string,id:string,name:string,input:map<string,string>,text:string,tool_use_id:string,content:string>"


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(traj, turn, body): each file is a JSON list of request bodies; a body stays JSON text, as its shape varies."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("traj"), F.col("value"))
    return raw.select("traj", F.posexplode(F.from_json("value", "array<string>")).alias("turn", "body"))


def messages(bodies: DataFrame) -> DataFrame:
    """(…, idx, role, text) of bodies (…, body): content as text, or the texts of its blocks, one below the other."""
    rows = bodies.withColumn("m", F.from_json(F.coalesce(F.get_json_object("body", "$.messages"), F.get_json_object("body", "$.input")), "array<struct<role:string,content:string,output:string>>"))
    x = rows.select(*[c for c in bodies.columns if c != "body"], F.posexplode("m").alias("idx", "x"))
    blocks = F.from_json("x.content", f"array<{BLOCK}>")
    text = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], b["content"], F.concat_ws(" ", b["name"], F.to_json(b["input"])))), "\n")
    plain = F.when(F.col("x.content").startswith("["), text).otherwise(F.col("x.content"))
    return x.select(*[c for c in x.columns if c != "x"], F.col("x.role").alias("role"), F.coalesce(plain, F.col("x.output"), F.lit("")).alias("text"))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, control, treatment, rationale): one JSON object a file."""
    return spark.read.schema("id string, control boolean, treatment boolean, rationale string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def battery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, type string, q string, files array<string>, key string, test_sh string").option("multiLine", True).json(path)


def flaws(records: DataFrame) -> DataFrame:
    """(id, flaw) of battery records that are not valid: the first rule each breaks."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    flaw = F.when(blank("id") | blank("q") | blank("key"), "id, q and key must not be empty").when(F.coalesce(F.size("files"), F.lit(0)) < 1, "files must not be empty").when(~F.coalesce(F.col("type").isin(*BATTERY_TYPES), F.lit(False)), "unknown type")
    return records.select("id", flaw.alias("flaw")).where("flaw is not null")


def shell_commands(scripts: DataFrame) -> DataFrame:
    """(id, line_no, tool, path, args) of the reading commands of scripts (id, text); # begins a comment."""
    tools = "|".join((*PATH_TOOLS, *SEARCH_TOOLS, *LIST_TOOLS))
    lines = scripts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    x = lines.withColumn("cmd", F.trim(F.substring_index("raw", "#", 1))).withColumn("tool", F.regexp_extract("cmd", rf"^({tools})\b", 1)).where("tool <> ''")
    rest = F.trim(F.substr("cmd", F.length("tool") + 1))
    words = F.filter(F.split(rest, r"\s+"), lambda t: ~t.startswith("-") & (t != ""))
    takes_path = F.col("tool").isin(*PATH_TOOLS)
    return x.select("id", "line_no", "tool", F.when(takes_path, F.coalesce(F.get(words, F.size(words) - 1), rest)).alias("path"), F.when(~takes_path, rest).alias("args"))


def source_reads(commands: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(id, path): distinct source files that scripts read or search."""
    ends = lambda t: F.lower(t).rlike("(?:" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")
    shown = F.when(F.col("path").isNotNull(), F.array("path")).when(F.col("tool").isin(*SEARCH_TOOLS), F.filter(F.split("args", r"\s+"), lambda t: ~t.startswith("-"))).otherwise(F.array().cast("array<string>"))
    return commands.select("id", F.explode(F.filter(shown, ends)).alias("path")).distinct()


def select_tasks(tasks: DataFrame, suffixes: tuple[str, ...], keywords: str, least: int = 2) -> DataFrame:
    """(id, selected, reason) of tasks (id, has_repo, instruction, text): about code, and reading `least` source files."""
    n = source_reads(shell_commands(tasks), suffixes).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    code = F.coalesce(F.col("has_repo"), F.lit(False)) | F.coalesce(F.col("instruction"), F.lit("")).rlike(rf"(?i)\b(?:{keywords})\b")
    found = F.coalesce("n", F.lit(0).cast("bigint"))
    reason = F.when(~code, "no code signal").when(found < least, F.concat(F.lit("too few source files read: "), found.cast("string"))).otherwise(F.concat(F.lit("selected: "), found.cast("string"), F.lit(" source files read")))
    return tasks.join(n, "id", "left").select("id", (code & (found >= least)).alias("selected"), reason.alias("reason"))


def in_scope(paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """Paths under any of the prefixes, with either slash."""
    norm, out = F.replace("path", F.lit("\\"), F.lit("/")), F.lit(False)
    for p in prefixes:
        out = out | norm.startswith(p.replace("\\", "/"))
    return paths.where(out)


def protected(branch: Column, names: tuple[str, ...] = ("main", "master")) -> Column:
    return branch.isin(*names)


@dataclass
class Settings:
    threshold: int = 50
    bound: bool = False
    fresh_results: int = 2


def settings(text: str, table: str = "index") -> Settings:
    """Settings from TOML text; malformed text is a ValueError, missing values are defaults."""
    try:
        data = tomllib.loads(text).get(table, {})
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"malformed settings: {e}") from e
    return Settings(**{f.name: type(f.default)(data[f.name]) for f in fields(Settings) if f.name in data})
