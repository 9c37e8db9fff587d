"""Scan of nested request bodies: leaves with the scope in which they stand, then the detectors a leaf's scope asks for.

A body is walked level by level: all containers of a level, of all bodies at once, are exploded by one lateral
`variant_explode`, and each child's scope follows from its parent's columns.  Levels are written to the shared
folder, so plans stay short and nothing stays cached.  Of a list of turns only the last
actor's is live, and only while nothing but tool results follows.  A body's violation is that of its first leaf
in order of places, so it is one `min_by` a body.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import lower_ascii
from meterlake.operators import scan
from meterlake.tables import cut

ARGS, CONTENT, PROSE, HISTORY = "args", "content", "prose", "history"

#: Words in the names of tools, whole names, and keys of leaves.
SHELLS = ["bash", "shell", "exec", "terminal", "powershell", "run_command", "run_shell", "command_exec", "system_exec", "shell_command"]
SHELL_NAMES = ["sh", "cmd", "run"]
EDITORS = ["write", "edit", "str_replace", "create_file", "apply_patch", "notebook", "new_file", "save_file", "update_file", "insert_edit"]
SEARCHES = [
    "grep", "glob", "ripgrep", "websearch", "web_search", "webfetch", "web_fetch", "fetch_url", "read_url", "search",
    "find_files", "list_dir", "list_files", "codebase_search",
]
PROMPT_NAMES = ["agent", "task", "subagent", "dispatch", "dispatch_agent", "oracle", "delegate"]
PROMPT_PATTERN = r"subagent|[_-]agent$|^agent[_-]|^task_|^dispatch_"
PATH_KEYS = [
    "path", "filepath", "file_path", "file", "filename", "fname", "notebook_path", "notebookpath", "target_file", "targetfile", "target_path",
    "targetpath", "dir", "directory", "folder", "src", "source", "source_path", "dest", "destination", "dest_path", "output_path", "outputpath",
    "output_file", "out_file", "old_path", "new_path", "abs_path", "absolute_path", "relative_path", "cwd", "workdir", "working_directory", "pathname",
]
PATH_ENDINGS = r"_(path|file|dir|directory)$"
NOTE_KEYS = ["description", "explanation", "comment", "reasoning", "thought", "rationale", "justification", "summary", "note", "notes", "purpose", "intent"]
TURN_KEYS = ["messages", "contents", "input"]
LONGEST_PATH = 512


def _text(v: Column, path: str) -> Column:
    """A string at a path of a variant; null for other types."""
    at = F.variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.variant_get(at, "$", "string"))


def _any(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])


def is_editor(tool: Column) -> Column:
    return F.coalesce(_any(lower_ascii(tool), EDITORS), F.lit(False))


def tool_scope(tool: Column) -> Column:
    """Scope of a tool's arguments by its name; an unknown tool is as strict as a shell."""
    n = lower_ascii(tool)
    return (
        F.when(n.isin(SHELL_NAMES) | _any(n, SHELLS), ARGS).when(_any(n, EDITORS) | _any(n, SEARCHES), CONTENT)
        .when(n.isin(PROMPT_NAMES) | n.rlike(PROMPT_PATTERN), PROSE).otherwise(ARGS)
    )


def holds_arguments(key: Column, parent: Column) -> Column:
    kind = F.coalesce(_text(parent, "$.type"), F.lit(""))
    return key.isin("tool_calls", "function_call", "functionCall") | ((key == "input") & kind.endswith("tool_use")) | (key.isin("arguments", "args") & kind.endswith("_call"))


def _actor(turn: Column) -> Column:
    return F.coalesce(_text(turn, "$.role").isin("assistant", "model"), F.lit(False)) | F.coalesce(_text(turn, "$.type").endswith("_call"), F.lit(False))


def _result(turn: Column) -> Column:
    role = F.coalesce(_text(turn, "$.role"), F.lit(""))
    blocks = F.coalesce(*[F.try_variant_get(turn, p, "array<variant>") for p in ("$.content", "$.parts")])
    holds = F.exists(blocks, lambda b: F.coalesce(_text(b, "$.type") == "tool_result", F.lit(False)) | F.variant_get(b, "$.functionResponse", "variant").isNotNull())
    own = F.coalesce(_text(turn, "$.type").endswith("_call_output"), F.lit(False))
    return own | (role == "tool") | (role.isin("user", "function") & F.coalesce(holds, F.lit(False)))


def live_turn(turns: Column) -> Column:
    """Place of the turn that is in flight, from 0; -1 if none is."""
    actors = F.transform(turns, _actor)
    last = F.size(actors) - F.array_position(F.reverse(actors), F.lit(True)).cast("int")
    after = F.slice(turns, last + 2, F.size(turns))
    return F.when(F.array_contains(actors, F.lit(True)) & F.forall(after, _result), last).otherwise(-1)


def leaves(bodies: DataFrame, body: str = "body", key: str = "id", entry: str = "request") -> DataFrame:
    """(key, place, scope, tool, slot, text): every string of the bodies that are JSON, with the key of the object
    it stands in (through lists) as its slot; places order a body's leaves.

    ``entry``: a request's turns and calls have their scopes; of a message to a tool server the arguments of a call
    count, as a shell's where the tool is one, else as contents; ``strict`` takes every leaf for a shell's argument."""
    spark = bodies.sparkSession
    start = bodies.select(F.col(key).alias("id"), F.try_parse_json(F.regexp_replace(F.col(body), r"^\x{FEFF}", "")).alias("v")).filter("v is not null")
    scope, tool = F.lit(ARGS if entry == "strict" else PROSE), F.lit(None).cast("string")
    if entry == "server":
        name = _text(F.col("v"), "$.params.name")
        shell = F.coalesce(lower_ascii(name).isin(SHELL_NAMES) | _any(lower_ascii(name), SHELLS), F.lit(False))
        start = start.filter(_text(F.col("v"), "$.method") == "tools/call").select("id", F.variant_get("v", "$.params.arguments", "variant").alias("v"), name.alias("name"), F.when(shell, ARGS).otherwise(CONTENT).alias("as"))
        start, scope, tool = start.filter("v is not null"), F.col("as"), F.col("name")
    level = start.select(
        "id", F.array().cast("array<int>").alias("place"), scope.alias("scope"), tool.alias("tool"),
        F.lit(None).cast("string").alias("slot"), F.lit(None).cast("int").alias("live"), "v",
    )
    known, members = "kind in ('OBJECT', 'ARRAY', 'STRING')", _members()
    kind = F.substring_index(F.schema_of_variant("v"), "<", 1)
    while True:
        for _ in range(LEVELS):
            inner = spark.sql("SELECT t.*, e.pos, e.key AS k, e.value AS c FROM {t} t, LATERAL variant_explode_outer(t.v) e", t=level.withColumn("kind", kind).filter(known))
            level = inner.filter("kind = 'STRING' or pos is not null").select(*members)  # empty containers have no members
        level = cut(level.withColumn("kind", kind).filter(known), "level")
        if level.filter("kind <> 'STRING'").isEmpty():
            return level.select(F.col("id").alias(key), "place", "scope", "tool", "slot", F.variant_get("v", "$", "string").alias("text"))


#: Levels of a body that are opened in one job; deeper ones take further jobs.
LEVELS = 7


def _members() -> list[Column]:
    """Columns of the members of a level's containers; strings stay as they are.  Made once for all levels."""
    leaf, prose, named = F.col("kind") == "STRING", F.col("scope") == PROSE, F.col("k").isNotNull()
    turns = F.when(prose & F.col("k").isin(TURN_KEYS), F.try_variant_get("c", "$", "array<variant>"))
    told = F.exists(turns, lambda t: F.variant_get(t, "$.role", "variant").isNotNull() | F.variant_get(t, "$.type", "variant").isNotNull())
    name = F.coalesce(_text(F.col("v"), "$.name"), _text(F.col("v"), "$.function.name"))
    args = prose & named & holds_arguments(F.col("k"), F.col("v"))
    turn = F.col("live").isNotNull()
    return [
        F.col("id"), F.when(leaf, F.col("place")).otherwise(F.concat("place", F.array("pos"))).alias("place"),
        F.when(leaf, F.col("scope")).when(turn, F.when(F.col("pos") == F.col("live"), PROSE).otherwise(HISTORY)).when(args & ~F.coalesce(told, F.lit(False)), tool_scope(name)).otherwise(F.col("scope")).alias("scope"),
        F.when(leaf, F.col("tool")).when(~turn, F.when(args, F.coalesce(name, F.col("tool"))).otherwise(F.col("tool"))).alias("tool"),
        F.when(leaf, F.col("slot")).when(~turn, F.coalesce("k", "slot")).alias("slot"), F.when(~leaf & told, live_turn(turns)).alias("live"), F.when(leaf, F.col("v")).otherwise(F.col("c")).alias("v"),
    ]


def visible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{scan.INVISIBLE}]", "")


#: Bytes of a leaf that is looked into and bytes decoded of it, runs, and their least lengths.
LONGEST_LEAF, MOST_DECODED, MOST_RUNS, LEAST_RUN, LEAST_HEX = 256 * 1024, 256 * 1024, 16, 32, 40
ALPHABET = "A-Za-z0-9+/=_-"


def _let(x: Column, f) -> Column:
    """``f`` of a value that is made once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _decoded(run: Column, budget: Column) -> Column:
    """(budget, texts): a run read as hex and as base64, each cut to what the budget leaves, if it is text."""
    text = lambda b: F.try_validate_utf8(b.cast("string"))
    plain = F.translate(F.substring_index(run, "=", 1), "-_", "+/")
    whole = F.left(plain, F.length(plain) - F.when(F.length(plain) % 4 == 1, 1).otherwise(0))
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("="))
    hexed = F.when(run.rlike(f"^[0-9a-fA-F]{{{LEAST_HEX},}}$"), F.try_to_binary(F.left(run, F.length(run) - F.length(run) % 2), F.lit("hex")))
    within = lambda b, n: F.substring(b, F.lit(1), n)
    size = lambda b: F.coalesce(F.length(b), F.lit(0))

    def both(h: Column) -> Column:
        left = budget - size(h)
        return _let(within(F.try_to_binary(padded, F.lit("base64")), left), lambda b: F.struct((left - size(b)).alias("budget"), F.array_distinct(F.array_compact(F.array(text(h), text(b)))).alias("texts")))

    return _let(within(hexed, budget), both)


def encoded(text: Column) -> Column:
    """Texts hidden in the first sixteen runs of base64 or hex, and in those that are one run themselves; a leaf's
    decoded bytes are limited, through all its runs."""
    runs = F.slice(F.regexp_extract_all(text, F.lit(f"[{ALPHABET}]{{{LEAST_RUN},}}"), F.lit(0)), 1, MOST_RUNS)
    state = lambda budget, out: F.struct(budget.alias("budget"), out.alias("out"))

    def inner(a: Column, t: Column) -> Column:
        bare = F.trim(t, F.lit(" \t\r\n"))
        again = _let(_decoded(bare, a["budget"]), lambda r: state(r["budget"], F.concat(a["out"], F.array(t), r["texts"])))
        return F.when(bare.rlike(f"^[{ALPHABET}]{{{LEAST_RUN},}}$") & (F.length(bare) <= F.length(text)), again).otherwise(state(a["budget"], F.concat(a["out"], F.array(t))))

    def step(a: Column, run: Column) -> Column:
        return _let(_decoded(run, a["budget"]), lambda r: F.aggregate(r["texts"], state(r["budget"], a["out"]), inner))

    none = F.array().cast("array<string>")
    found = F.aggregate(runs, state(F.lit(MOST_DECODED), none), step)["out"]
    return F.when((F.octet_length(text) <= LONGEST_LEAF) & text.rlike(f"[{ALPHABET}]{{{LEAST_RUN}}}"), found).otherwise(none)


def violation(text: Column, scope: Column, tool: Column, slot: Column, paths: list[str], commands: list[str], canaries: list[str] = (), exfil: bool = False, cleaned: Column | None = None, allowed: list[str] = (), destination: Column | None = None) -> Column:
    """The first violation of a leaf, in the order of checks; ``cleaned``: its text without hidden characters.  A text that
    names an ``allowed`` path is not checked for denied ones, but for all else.  With a ``destination``, a credential of
    another provider is misdirected."""
    def canary(t: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in canaries if len(c) >= 8], F.lit(False))

    def denied(t: Column) -> Column:
        return scan.path_denied(t, paths) & ~scan.path_denied(t, allowed) if allowed else scan.path_denied(t, paths)

    def data(t: Column) -> Column:
        t = F.when(t.rlike(f"[{scan.INVISIBLE}]"), visible(t)).otherwise(t)
        return F.when(denied(t), "path_blocked").when(canary(t), "canary").when(scan.secret_kind(t).isNotNull(), "secret").when(F.size(scan.card_numbers(t)) > 0, "card_number").when(scan.has_ssn(t), "ssn")

    k, deep, t = lower_ascii(slot), scope.isin(ARGS, CONTENT), visible(text) if cleaned is None else cleaned
    command = (scope == ARGS) & ~F.coalesce(k.isin(NOTE_KEYS), F.lit(False))
    place = (scope == CONTENT) & F.coalesce(k.isin(PATH_KEYS) | k.rlike(PATH_ENDINGS), F.lit(False)) & (F.octet_length(t) <= LONGEST_PATH) & ~F.contains(t, F.lit("\n"))
    values = deep & ~((scope == CONTENT) & is_editor(tool))
    astray = F.lit(False) if destination is None else F.coalesce(credential_provider(t) != destination, F.lit(False))
    hidden = F.filter(F.transform(encoded(t), lambda x: _let(x, data)), lambda x: x.isNotNull())
    return (
        F.when((scope != HISTORY) & canary(text), "canary").when(deep & (scan.hidden_characters(text) >= 8), "hidden_text").when(deep & canary(t), "canary")
        .when((command | place) & denied(t), "path_blocked").when(command & scan.command_denied(t, commands), "command_blocked")
        .when(command & scan.destructive(t), "destructive").when((command | place) & scan.network_mount(t), "mount_blocked")
        .when(values & astray, "misdirected").when(values & scan.secret_kind(t).isNotNull(), "secret").when(F.lit(exfil) & command & scan.exfiltration(t), "exfiltration")
        .when(values & (F.size(scan.card_numbers(t)) > 0), "card_number").when(values & scan.has_ssn(t), "ssn").when(values & (F.size(hidden) > 0), F.get(hidden, F.lit(0)))
    )


def violations(
    bodies: DataFrame, paths=scan.DENY_PATHS, commands=scan.DENY_COMMANDS, canaries=(), exfil: bool = False, body: str = "body", key: str = "id",
    allowed=(), destination: str | None = None, entry: str = "request",
) -> DataFrame:
    """(key, violation, scope, tool) of the first violating leaf of each body that has one.  ``destination``: the column
    with the provider to which a body goes."""
    found = leaves(bodies, body, key, entry).withColumn("cleaned", visible(F.col("text")))
    if destination:
        found = found.join(bodies.select(key, F.col(destination).alias("destination")), key)
    found = cut(found, "leaves")
    what = violation(F.col("text"), F.col("scope"), F.col("tool"), F.col("slot"), paths, commands, canaries, exfil, F.col("cleaned"), allowed, F.col("destination") if destination else None)
    # a generator of one row keeps the filter from making the whole expression twice
    found = found.select(key, "place", "scope", "tool", F.explode(F.array(what)).alias("violation"))
    first = found.filter("violation is not null").groupBy(key).agg(F.min_by(F.struct("violation", "scope", "tool"), "place").alias("x"))
    return first.select(key, "x.violation", "x.scope", "x.tool")


#: Whose credentials a pattern finds.
CREDENTIALS_OF = {"anthropic": "anthropic", "openai": "openai", "google": "google"}
#: Share of characters that could not be decoded from which an upload counts as binary.
BINARY = 0.30


def credential_provider(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed([x for x in scan.SECRETS if x[0] in CREDENTIALS_OF]):
        out = F.when(text.rlike(pattern), CREDENTIALS_OF[kind]).otherwise(out)
    return out


def upload_violation(text: Column, canaries: list[str] = ()) -> Column:
    """What the text of an uploaded file holds: a canary, a credential, a card or a person's number.  Text of which too
    much could not be decoded is binary and not looked into; of other text all is."""
    canary = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in canaries if len(c) >= 8], F.lit(False))
    binary = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit(""))) > BINARY * F.greatest(F.length(text), F.lit(1))
    found = F.when(canary, "canary").when(scan.secret_kind(text).isNotNull(), "secret").when(F.size(scan.card_numbers(text)) > 0, "card_number").when(scan.has_ssn(text), "ssn")
    return F.when(~binary, found)


def unscannable(body: Column) -> Column:
    """Something that is no JSON, a byte order mark aside."""
    bare = F.regexp_replace(body, r"^\x{FEFF}", "")
    return F.coalesce((F.length(bare) > 0) & F.try_parse_json(bare).isNull(), F.lit(False))
