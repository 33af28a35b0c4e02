"""Volatile parts that clients put into prompts: known ones go or become instructions, everything else is kept.

The rules are line grammars over arrays of lines, so they stay in the JVM and no expression backtracks over a long text;
byte limits are tested first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Clients, names of rules, wordings, patterns of lines and limits in bytes.
CLAUDE_CODE, CODEX, GEMINI_CLI = "claude_code", "codex", "gemini_cli"
ENV_LINE = r"^(Working directory|Is directory a git repo|Additional working directories|Platform|OS Version|Today's date): [^\n]{1,512}\z"
BILLING = r"^x-anthropic-billing-header: [\x20-\x7e]{1,500}\z"
GIT_HEADER = "gitStatus: This is the git status at the start of the conversation. Note that this status is a snapshot in time, and will not update during the conversation."
GIT_BRANCH = r"^Current branch: [^\n]{0,256}\z"
GIT_MAIN = r"^Main branch \(you will usually use this for PRs\): [^\n]{0,256}\z"
GIT_USER = r"^Git user: [^\n]{0,256}\z"
GIT_STATUS = r"^(?:[ MADRCUT?!]{2} [^\n]{1,512}|\(clean\)|\.\.\. \(truncated because it exceeds [^\n]{1,200}\))\z"
GIT_COMMIT = r"^[0-9a-f]{7,40} [^\n]{0,512}\z"
CURRENT_DATE = r"# currentDate\nToday's date is \d{4}[-/]\d{2}[-/]\d{2}\.\n?"
ENVIRONMENT_LINE = r"^[\t\n\f\r ]*<(cwd|approval_policy|sandbox_mode|network_access|shell|current_date|timezone)>[^<\n]{0,512}</\1>\z"
ROOT_LINE = r"^[\t\n\f\r ]*<root>[^<\n]{1,512}</root>\z"
IDE = r"^[\t\n\f\r ]*<system-reminder>\n(?:The user opened the file [^\n]{1,512} in the IDE\.(?: This may or may not be related to the current task\.)?|The user selected the lines? [0-9]{1,6}(?: to [0-9]{1,6})? from [^\n]{1,512})\n</system-reminder>"
TODO_PREFIX = "<system-reminder>\nYour todo list has changed. DO NOT mention this explicitly to the user. Here are the latest contents of your todo list:\n\n"
TODO_SUFFIX = ". Continue on with the tasks at hand if applicable.\n</system-reminder>"
TODO_EMPTY = "<system-reminder>\nThis is a reminder that your todo list is currently empty. DO NOT mention this to the user explicitly because they are already aware. If you are working on tasks that would benefit from a todo list please use the TodoWrite tool to create one. If not, please feel free to ignore. Again do not mention this message to the user.\n</system-reminder>"
CONTEXT_PREFIX = "<system-reminder>\nAs you answer the user's questions, you can use the following context:\n"
AGENTS_PREFIX = "# AGENTS.md instructions for "
SESSION_FIRST = "This is the Gemini CLI. We are setting up the context for our chat."
SESSION_TREE = "Here is the folder structure of the current working directories:"
SESSION_LINES = (r"^Today's date is [^\n]{1,120}\z", r"^My operating system is: [^\n]{1,64}\z", r"^I'm currently working in the directory: [^\n]{1,512}\z")
SESSION_REST = r"^(?:Showing up to \d+ items \(files \+ folders\)\.[^\n]{0,300}|(?:│   |    )*[├└]───[^\n]{1,256}|/[^\n]{0,511}/|\.\.\.)?\z"
MOST = {"env": 2048, "billing": 512, "git": 6144, "ide": 2048, "todo": 8192, "environment": 4096, "session": 16384}

_STRING = r'"(?>(?:[^"\\]|\\[^\n]){%s})"'
_ITEM = r'\{"content":' + _STRING % "1,500" + r',"status":"(?:pending|in_progress|completed)"(?:,"(?:activeForm|priority|id)":' + _STRING % "0,500" + r")*\}"
TODO_LIST = rf"^\[(?:{_ITEM}(?:,{_ITEM})*)?\]\z"

WHITE = "\t\n\v\f\r \u0085      　" + "".join(map(chr, range(0x2000, 0x200B)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _fits(text: Column, most: int, accept: Column) -> Column:
    """accept, read only for texts within the limit."""
    return F.when(F.octet_length(text) <= most, accept).otherwise(False)


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def without_env(text: Column) -> Column:
    """text without its <env> parts all of whose lines are known."""
    pattern = r"<env>(?=\n)[\s\S]*?\n</env>"

    def known(part: Column) -> Column:
        body = F.substring(part, F.lit(len("<env>\n") + 1), F.length(part) - len("<env>\n\n</env>"))
        return _fits(part, MOST["env"], F.forall(_lines(body), lambda line: line.rlike(ENV_LINE)))

    parts = F.regexp_extract_all(text, F.lit(pattern), 0)
    ends = F.concat(F.transform(parts, lambda p: F.when(known(p), "").otherwise(p)), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), ends, lambda a, b: F.concat(a, b)), "")


def without_git_status(text: Column) -> Column:
    """text without a complete snapshot of a repository at its end."""
    after = F.substring_index(text, GIT_HEADER, -1)
    before = F.left(text, F.length(text) - F.length(after) - len(GIT_HEADER))
    rest = F.rtrim(after, F.lit(" \n"))
    lines = _lines(rest)  # the first is what follows the header in its line
    line = lambda i: F.get(lines, F.lit(i) if isinstance(i, int) else i)
    head = (line(0) == "") & line(1).rlike(GIT_BRANCH) & (line(2) == "") & line(3).rlike(GIT_MAIN) & (line(4) == "")
    user = F.coalesce(line(5).rlike(GIT_USER), F.lit(False))
    at = F.when(user, 7).otherwise(5)
    head = head & (~user | (line(6) == "")) & (line(at) == "Status:")
    tail = F.slice(lines, at + 2, F.size(lines))
    blank = F.array_position(tail, F.lit("")).cast("int")
    states, commits = F.slice(tail, F.lit(1), F.greatest(blank - 1, F.lit(0))), F.slice(tail, blank + 2, F.size(lines))
    good = (blank > 0) & F.forall(states, lambda s: s.rlike(GIT_STATUS)) & (F.get(tail, blank) == "Recent commits:")
    good = good & F.size(commits).between(1, 20) & F.forall(commits, lambda c: c.rlike(GIT_COMMIT))
    there = F.contains(text, F.lit(GIT_HEADER)) & ((before == "") | F.endswith(before, F.lit("\n")))
    found = F.when(there, _fits(rest, MOST["git"] - len(GIT_HEADER), head & good)).otherwise(False)
    return F.when(found, before).otherwise(text)


def without_ide_note(text: Column) -> Column:
    note = F.regexp_extract(text, IDE, 0)
    return F.when((note != "") & (F.octet_length(note) <= MOST["ide"]), F.substring(text, F.length(note) + 1, F.length(text))).otherwise(text)


def is_todo_change(text: Column) -> Column:
    inner = F.substring(text, F.lit(len(TODO_PREFIX) + 1), F.length(text) - len(TODO_PREFIX) - len(TODO_SUFFIX))
    return _fits(text, MOST["todo"], F.startswith(text, F.lit(TODO_PREFIX)) & F.endswith(text, F.lit(TODO_SUFFIX)) & inner.rlike(TODO_LIST))


def is_environment(text: Column) -> Column:
    """One known tag a line, or roots inside their own tag; the state is 0 outside it, 1 inside, -1 after a strange line."""
    lines = _lines(text)
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))

    def step(state: Column, line: Column) -> Column:
        tag = _trim(line)
        outside = F.when(tag == "<writable_roots>", 1).when(line.rlike(ENVIRONMENT_LINE), 0).otherwise(-1)
        inside = F.when(tag == "</writable_roots>", 0).when(line.rlike(ROOT_LINE), 1).otherwise(-1)
        return F.when(state == 0, outside).when(state == 1, inside).otherwise(-1)

    whole = (F.size(lines) >= 2) & (F.get(lines, F.lit(0)) == "<environment_context>") & (F.element_at(lines, -1) == "</environment_context>")
    return _fits(text, MOST["environment"], whole & (F.aggregate(inner, F.lit(0), step) == 0))


def is_session(text: Column) -> Column:
    lines = _lines(text)
    head = (F.get(lines, F.lit(0)) == SESSION_FIRST) & (F.get(lines, F.lit(4)) == SESSION_TREE)
    for i, pattern in enumerate(SESSION_LINES):
        head = head & F.get(lines, F.lit(i + 1)).rlike(pattern)
    rest = F.forall(F.slice(lines, F.lit(6), F.size(lines)), lambda line: line.rlike(SESSION_REST))
    return _fits(text, MOST["session"], (F.size(lines) >= 6) & head & rest)


def is_agents(text: Column) -> Column:
    agents = F.startswith(text, F.lit(AGENTS_PREFIX)) & F.contains(text, F.lit("\n<INSTRUCTIONS>")) & F.endswith(text, F.lit("</INSTRUCTIONS>"))
    return agents | (F.startswith(text, F.lit("<user_instructions>")) & F.endswith(text, F.lit("</user_instructions>")))


def apply_templates(blocks: DataFrame) -> DataFrame:
    """blocks (client, role, first_message, context_prefix, text, ...) with `kept`, `stripped`, `dropped`, `instruction`.

    role is 'system' or 'user'; first_message says that a block is of the first user message, context_prefix that no
    answer comes before it. kept is what is left of the text, empty if the block is dropped; stripped names the rules that
    matched, in their order. Text that no rule matches is kept as it is; a null text stays null and matches nothing.
    """
    client, text = F.col("client"), F.col("text")
    system, user = F.col("role") == "system", F.col("role") == "user"
    first, prefix = F.coalesce("first_message", F.lit(False)), F.coalesce("context_prefix", F.lit(False))
    claude = client == CLAUDE_CODE
    # segments go first, each on what the one before left; the names of temporary columns are taken off at the end
    out = blocks.withColumn("a_", F.when(claude & system, without_env(text)).when(claude & user, without_ide_note(text)).otherwise(text))
    out = out.withColumn("b_", F.when(claude & system, without_git_status(F.col("a_"))).otherwise(F.col("a_"))).withColumn("t_", _trim(F.col("b_")))
    whole, left, t = _trim(text), F.col("b_"), F.col("t_")
    billing = claude & system & _fits(whole, MOST["billing"], whole.rlike(BILLING))
    user_claude = claude & user
    blocks_ = {
        "claude_todo_empty_reminder": user_claude & (t == TODO_EMPTY),
        "claude_todo_changed_reminder": user_claude & is_todo_change(t),
        "codex_environment_context": (client == CODEX) & user & is_environment(t),
        "gemini_session_context": (client == GEMINI_CLI) & user & first & is_session(t),
    }
    texts = {
        "claude_md_context": user_claude & first & F.startswith(t, F.lit(CONTEXT_PREFIX)) & F.endswith(t, F.lit("</system-reminder>")),
        "codex_agents_md": (client == CODEX) & user & prefix & is_agents(t),
    }
    named = lambda rules: F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in rules.items()])
    out = out.withColumn("drop_", F.when(billing, F.lit("claude_billing_header")).otherwise(named(blocks_)))
    out = out.withColumn("turn_", F.when(F.col("drop_").isNull(), named(texts)))
    segments = F.array(
        F.when(~F.coalesce(billing, F.lit(False)) & system & (F.col("a_") != text), F.lit("claude_env")),
        F.when(~F.coalesce(billing, F.lit(False)) & system & (left != F.col("a_")), F.lit("claude_git_status")),
        F.when(user & (F.col("a_") != text), F.lit("claude_ide_reminder")),
        F.col("drop_"),
        F.col("turn_"),
    )
    kept = F.when(F.col("drop_").isNotNull(), F.lit("")).when(F.col("turn_") == "claude_md_context", F.regexp_replace(left, CURRENT_DATE, "")).otherwise(left)
    return out.select(*blocks.columns, kept.alias("kept"), F.array_compact(segments).alias("stripped"), F.col("drop_").isNotNull().alias("dropped"), F.col("turn_").isNotNull().alias("instruction"))
