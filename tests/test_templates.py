"""The rules of volatile prompt parts, case by case."""

from __future__ import annotations

import pytest

from modlens.functions import templates as tp

GIT = tp.GIT_HEADER + "\nCurrent branch: main\n\nMain branch (you will usually use this for PRs): main\n\n{user}Status:\n M a.py\n?? b\n\nRecent commits:\nabcdef0 First\n"
ITEM = '{"content":"a \\"},{\\" b","status":"pending","id":"1"}'
SESSION = "\n".join([tp.SESSION_FIRST, "Today's date is Monday.", "My operating system is: linux", "I'm currently working in the directory: /a", tp.SESSION_TREE, "", "/a/", "├───b", "│   └───c", "..."])
AGENTS = tp.AGENTS_PREFIX + "/a\n\n<INSTRUCTIONS>\nx\n</INSTRUCTIONS>"
CONTEXT = tp.CONTEXT_PREFIX + "# currentDate\nToday's date is 2026-01-02.\nrest</system-reminder>"
IDE = "<system-reminder>\nThe user opened the file /a in the IDE.\n</system-reminder>"
# client, role, first message, before any answer, text -> kept, rules, dropped, instruction
CASES = [
    ("claude_code", "system", False, False, "a<env>\nPlatform: x\n</env>b<env>\nSecret: x\n</env><env>\nPlatform: y\n</env>", "ab<env>\nSecret: x\n</env>", ["claude_env"], False, False),
    ("claude_code", "system", False, False, "<env>\n</env>", "<env>\n</env>", [], False, False),
    ("claude_code", "system", False, False, "<env>\n" + "\n".join(["Platform: " + "x" * 500] * 5) + "\n</env>", None, [], False, False),
    ("claude_code", "system", False, False, "p\n" + GIT.format(user=""), "p\n", ["claude_git_status"], False, False),
    ("claude_code", "system", False, False, "p\n" + GIT.format(user="Git user: me\n\n") + " \n", "p\n", ["claude_git_status"], False, False),
    ("claude_code", "system", False, False, "p " + GIT.format(user=""), None, [], False, False),
    ("claude_code", "system", False, False, "p\n" + GIT.format(user="") + "do this", None, [], False, False),
    ("claude_code", "system", False, False, "p\n" + GIT.format(user="") + "abcdef0 x\n" * 20, None, [], False, False),
    ("claude_code", "system", False, False, " x-anthropic-billing-header: a\n", "", ["claude_billing_header"], True, False),
    ("claude_code", "user", False, False, " x-anthropic-billing-header: a\n", None, [], False, False),
    ("claude_code", "user", False, False, IDE + " hello", " hello", ["claude_ide_reminder"], False, False),
    ("claude_code", "user", False, False, "x" + IDE, None, [], False, False),
    ("claude_code", "user", False, False, IDE + tp.TODO_EMPTY, "", ["claude_ide_reminder", "claude_todo_empty_reminder"], True, False),
    ("claude_code", "user", False, False, tp.TODO_PREFIX + f"[{ITEM},{ITEM}]" + tp.TODO_SUFFIX, "", ["claude_todo_changed_reminder"], True, False),
    ("claude_code", "user", False, False, tp.TODO_PREFIX + "[" + ",".join([ITEM] * 140) + "]" + tp.TODO_SUFFIX, "", ["claude_todo_changed_reminder"], True, False),
    ("claude_code", "user", False, False, tp.TODO_PREFIX + f"[{ITEM},do it]" + tp.TODO_SUFFIX, None, [], False, False),
    ("claude_code", "user", False, False, tp.TODO_PREFIX + "[" + ",".join([ITEM] * 200) + "]" + tp.TODO_SUFFIX, None, [], False, False),
    ("claude_code", "user", True, False, CONTEXT, tp.CONTEXT_PREFIX + "rest</system-reminder>", ["claude_md_context"], False, True),
    ("claude_code", "user", False, False, CONTEXT, None, [], False, False),
    ("codex", "user", False, False, "<environment_context>\n  <cwd>/a</cwd>\n<writable_roots>\n<root>/a</root>\n</writable_roots>\n</environment_context>\n", "", ["codex_environment_context"], True, False),
    ("codex", "user", False, False, "<environment_context>\n<cwd>/a</shell>\n</environment_context>", None, [], False, False),
    ("codex", "user", False, False, "<environment_context>\n<writable_roots>\n</environment_context>", None, [], False, False),
    ("codex", "user", False, True, AGENTS, AGENTS, ["codex_agents_md"], False, True),
    ("codex", "user", False, False, AGENTS, None, [], False, False),
    ("gemini_cli", "user", True, False, SESSION, "", ["gemini_session_context"], True, False),
    ("gemini_cli", "user", True, False, SESSION + "\nplease", None, [], False, False),
    ("gemini_cli", "user", False, False, SESSION, None, [], False, False),
    ("generic", "user", True, True, AGENTS, None, [], False, False),
    ("codex", "system", True, True, AGENTS, None, [], False, False),
    ("claude_code", "user", True, True, "", "", [], False, False),
    (None, "user", True, True, AGENTS, None, [], False, False),
]


@pytest.fixture(scope="module")
def applied(spark):
    rows = [(i, *c[:5]) for i, c in enumerate(CASES)] + [(-1, "claude_code", "user", True, True, None), (-2, "claude_code", None, None, None, AGENTS)]
    df = spark.createDataFrame(rows, "n long, client string, role string, first_message boolean, context_prefix boolean, text string")
    return {r["n"]: r for r in tp.apply_templates(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(applied, i):
    text, kept, rules, dropped, instruction = CASES[i][4:]
    got = applied[i]
    assert (got["kept"], got["stripped"], got["dropped"], got["instruction"]) == (text if kept is None else kept, rules, dropped, instruction)


def test_nulls(applied):
    assert (applied[-1]["kept"], applied[-1]["stripped"], applied[-1]["dropped"]) == (None, [], False)
    assert (applied[-2]["kept"], applied[-2]["stripped"]) == (AGENTS, [])
