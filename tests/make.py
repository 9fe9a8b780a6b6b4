"""Made-up transcripts of the three layouts."""

import json
from pathlib import Path

UUIDS = [f"{k:08x}-1111-4222-8333-{k:012x}" for k in range(1, 20)]


def write(path: Path, lines: list) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return path


def user(text, t=0, **more):
    return {"type": "user", "timestamp": f"2026-03-01T10:00:{t:02d}.000Z", "cwd": "/w/app", "version": "9.1", "gitBranch": "main", "sessionId": "s", "message": {"role": "user", "content": text}} | more


def assistant(mid, rid, usage, content=(), t=0, model="claude-test-1", **more):
    message = {"id": mid, "model": model, "usage": usage, "content": list(content)}
    message |= more.pop("message", {})
    return {"type": "assistant", "timestamp": f"2026-03-01T10:00:{t:02d}.000Z", "cwd": "/w/app", "version": "9.1", "sessionId": "s", "requestId": rid, "message": message} | more


def use(i=0, o=0, read=0, w5=0, w1=None):
    u = {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": read, "cache_creation_input_tokens": w5 + (w1 or 0)}
    return u | ({"cache_creation": {"ephemeral_5m_input_tokens": w5, "ephemeral_1h_input_tokens": w1}} if w1 is not None else {})


def text(x):
    return {"type": "text", "text": x}


def tool(i, name, **args):
    return {"type": "tool_use", "id": i, "name": name, "input": args}


def result(i, content):
    return {"type": "tool_result", "tool_use_id": i, "content": content}


def claude_root(root: Path) -> Path:
    """A main session, its subagent, an offloaded result, and a second session with a compaction."""
    a, b = UUIDS[0], UUIDS[1]
    write(root / "-w-app" / f"{a}.jsonl", [
        user("hello", 1),
        assistant("m1", "r1", use(1000, 300, 500), [{"type": "thinking", "thinking": "hm" * 5}], 2),
        assistant("m1", "r1", use(1000, 300, 500), [text("I say")], 3),
        assistant("m1", "r1", use(1000, 300, 500), [tool("t1", "mcp__github__get_issue", n=4)], 4),
        "{broken",
        "",
        "[1]",
        user([result("t1", "inline")], 5, toolUseResult={"stdout": "out", "stderr": "err"}),
        {"type": "novel", "x": 1},
        assistant("m2", "r2", use(10, 5, 90, 7, 3), [text("done"), tool("t2", "Read", p=1)], 6),
        user([result("t2", "big"), text("<task-notification>x")], 7),
        assistant("m2", "r9", use(10, 5, 80), [text("again")], 8, isSidechain=True),
        user("trailing", 9),
    ])
    write(root / "-w-app" / a / "subagents" / "deep" / "agent-x.jsonl", [
        user("go", 1), assistant("k1", "q1", use(600, 50), [text("sub")], 2), assistant("m1", "q2", use(1000, 300, 500), [text("copy")], 3),
    ])
    side = root / "-w-app" / a / "tool-results"
    side.mkdir(parents=True)
    (side / "t2.txt").write_text("long output")
    write(root / "-w-app" / f"{b}.jsonl", [
        user("x" * 40, 1), assistant("c1", "d1", use(15000, 600, 5000), [text("y" * 68)], 2), assistant("c2", "d2", use(), [], 3, isApiErrorMessage=True, model="<synthetic>"),
        user("s" * 160, 4, isCompactSummary=True), assistant("c3", "d3", use(200, 50, 800, 2000), [text("z" * 60)], 9, message={"diagnostics": {"cache_miss_reason": {"type": "system_changed", "cache_missed_input_tokens": 4500}}}),
        assistant("c4", "d4", {"input_tokens": 1, "iterations": [use(300, 80), use(200, 40)]}, [], 9, costUSD=0.25),
    ])
    return root


def line(kind, payload, t=0):
    return {"timestamp": f"2026-04-01T09:00:{t:02d}.000Z", "type": kind, "payload": payload}


def count(i, cached, o, total, reasoning=0):
    return line("event_msg", {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "cached_input_tokens": cached, "output_tokens": o, "reasoning_output_tokens": reasoning}, "total_token_usage": {"total_tokens": total}}})


def say(role, x):
    return line("response_item", {"type": "message", "role": role, "content": [{"type": "output_text" if role == "assistant" else "input_text", "text": x}]})


def codex_root(root: Path) -> Path:
    write(root / "2026" / "04" / f"rollout-{UUIDS[2]}.jsonl", [
        line("session_meta", {"id": UUIDS[2], "cwd": "/w/cx", "cli_version": "0.9", "git": {"branch": "dev"}, "base_instructions": {"text": "p" * 21}, "dynamic_tools": [{"name": "srv", "tools": [{"name": "a", "description": "d"}]}, {"name": "b"}]}),
        say("user", "early"),
        line("turn_context", {"model": "gpt-x", "user_instructions": "rules", "truncation_policy": {"limit": 10}}),
        say("user", "# AGENTS.md instructions and more"), say("developer", "sys"),
        line("response_item", {"type": "reasoning", "summary": [{"type": "summary_text", "text": "thought"}]}),
        line("response_item", {"type": "function_call", "name": "search", "namespace": "gh", "call_id": "c", "arguments": '{"q": 1}'}),
        line("response_item", {"type": "function_call_output", "call_id": "c", "output": {"content_items": [{"text": "ab"}, {"text": "cd"}]}}),
        line("response_item", {"type": "function_call_output", "call_id": "unknown", "output": "raw"}),
        say("assistant", "answer"),
        count(0, 0, 9, 1), count(18000, 12000, 600, 18600, 100),
        line("response_item", {"type": "sing"}), line("event_msg", {"type": "dance"}), line("event_msg", {"type": "user_message"}),
        line("turn_context", {"model": "gpt-y"}),
        line("compacted", {"message": "m" * 10, "window_number": 1, "window_id": "w"}), line("event_msg", {"type": "context_compacted"}), line("event_msg", {"type": "context_compacted"}),
        say("assistant", "after"), count(3000, 0, 10, 21610), count(5, 0, 0, 21610), count(5, 0, 0, 21610), count(7, 0, 0, 21610),
    ])
    return root


def pi_root(root: Path) -> Path:
    folder = root / "--w-pi--"
    e = lambda i, p, kind, t, **d: {"type": kind, "id": i, "parentId": p, "timestamp": f"2026-05-01T08:00:{t:02d}.000Z"} | d
    m = lambda role, **d: {"message": {"role": role} | d}
    u = {"input": 1000, "output": 200, "cacheRead": 500, "cacheWrite": 100, "cacheWrite1h": 25, "cost": {"input": 0.1, "output": 0.2, "cacheRead": 0.0, "cacheWrite": 0.04, "total": 0.34}}
    write(folder / f"2026-05-01T08-00-00-000Z_{UUIDS[3]}.jsonl", [
        {"type": "session", "version": 3, "id": UUIDS[3], "timestamp": "2026-05-01T08:00:00.000Z", "cwd": "/w/pi", "parentSession": "old"},
        e("1", None, "message", 1, **m("user", content="hi")),
        "",
        e("2", "1", "message", 2, **m("assistant", model="pm", usage=u, content=[{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "out"}, {"type": "text", "text": ""}, {"type": "toolCall", "name": "bash", "arguments": {"c": "ls"}}])),
        e("x", "1", "message", 3, **m("assistant", model="other", usage=u, content=[])),
        e("3", "2", "message", 4, **m("toolResult", toolName="bash", content=[{"type": "text", "text": "files"}])),
        e("4", "3", "message", 5, **m("bashExecution", command="a", output="b", excludeFromContext=True)),
        e("5", "4", "thinking_level_change", 6, thinkingLevel="high"), e("6", "5", "model_change", 7, modelId="pm2"), e("7", "6", "compaction", 8, summary="s" * 9, tokensBefore=8500),
        e("8", "7", "martian", 9), e("9", "8", "custom_message", 10, content="note", display=True), "{bad", {"type": "message", "id": "zz"},
        e("10", "9", "message", 11, **m("assistant", usage={"input": 7, "output": 1}, content=[{"type": "text", "text": "end"}])), e("11", "10", "message", 12, **m("robot")), e("12", "11", "message", 13, **m("user", content="late")),
    ])
    b = lambda i, p, kind, t, **d: {"kind": "entry", "seq": t, "type": kind, "id": i, "parentId": p, "timestamp": 1777600000000 + t} | d
    write(folder / f"2026-05-01T09-00-00-000Z_{UUIDS[4]}.jsonl", [
        {"kind": "header", "version": 4, "id": UUIDS[4], "timestamp": 1777600000000, "cwd": "/w/pb"},
        b("1", None, "message", 1, **m("user", content="q")), b("2", "1", "message", 2, **m("assistant", model="bm", usage=u, content=[{"type": "text", "text": "a"}])), b("3", "1", "message", 3, **m("assistant", model="bm", usage=u, content=[])),
        {"kind": "lane", "seq": 4, "laneId": "one", "entryId": "3"}, {"kind": "lane", "seq": 9, "laneId": "two", "entryId": "2"}, {"kind": "record", "seq": 10, "usage": {"totalTokens": 5}}, {"kind": "telemetry"}, {"kind": "lane"}, {"kind": "fact"}, {"kind": "entry"}, "nope",
    ])
    return root
