"""Per-file helper: the statements of one source file as flat rows. Which rows become units is decided by Spark jobs.

A row is (id, parent, last, kind, name, qualname, start, end, signature, digest, from, to, blank): ids count in reading order,
``last`` is the highest id below the row, ``from`` and ``to`` are the characters before its first line and through its last
one, ``blank`` tells that its first line is blank, and kinds are function, method, class, header, statement, comment and line. Python files are read
with the standard parser; JavaScript and TypeScript by bracket matching, so their spans can differ from a real grammar.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from bisect import bisect_left, bisect_right
from itertools import accumulate

FIELDS = ("id", "parent", "last", "kind", "name", "qualname", "start", "end", "signature", "digest", "from", "to", "blank", "member")
_SPACE = re.compile(r"\s+")


class Rows:
    def __init__(self, lines: list[str], tokens: list[tuple[int, str]], max_chars: int) -> None:
        self.lines, self.max_chars, self.rows = lines, max_chars, []
        self.offset = [0, *accumulate(len(x) + 1 for x in lines)]
        self.tokens = [t for _, t in tokens]
        self.token_lines = [n for n, _ in tokens]

    def add(self, parent: int, kind: str, name: str, qual: str, start: int, end: int, signature: str = "") -> dict:
        inside = self.tokens[bisect_left(self.token_lines, start):bisect_right(self.token_lines, end)]
        digest = hashlib.sha256("\0".join(inside).encode()).hexdigest()[:16]
        row = dict(zip(FIELDS, (len(self.rows), parent, 0, kind, name, qual, start, end, _SPACE.sub(" ", signature).strip()[:300], digest,
                                self.offset[start - 1], self.offset[end], not self.lines[start - 1].strip(),
                                parent >= 0 and self.rows[parent]["kind"] == "class")))
        self.rows.append(row)
        return row

    def close(self, row: dict) -> None:
        """Oversized rows without parts are handed on line by line."""
        if row["id"] == len(self.rows) - 1 and row["to"] - row["from"] - 1 > self.max_chars and row["kind"] != "line":
            for n in range(row["start"], row["end"] + 1):
                self.add(row["id"], "line", row["name"], row["qualname"], n, n)
        row["last"] = len(self.rows) - 1
        if row["kind"] == "line":
            row["last"] = row["id"]

    def header(self, cls: dict, first_member: int | None) -> None:
        """The part of a class before its first member; left out when only the declaration line remains."""
        end = cls["end"] if first_member is None else max(first_member - 1, cls["start"])
        while end > cls["start"] and not self.lines[end - 1].strip():
            end -= 1
        if first_member is None or sum(1 for x in self.lines[cls["start"] - 1:end] if x.strip()) > 1:
            self.close(self.add(cls["id"], "header", cls["name"], cls["qualname"], cls["start"], end, cls["signature"]))


def outline(text: str, language: str, max_chars: int) -> tuple[list[dict], bool]:
    """(rows, had_error) of one file."""
    lines = text.split("\n")
    try:
        rows, broken = (_python if language == "python" else _braces)(text, lines, max_chars)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        out = Rows(lines, [], max_chars)  # unreadable: keep the text, by lines
        for n, x in enumerate(lines, 1):
            if x.strip():
                out.close(out.add(-1, "statement", "", "", n, n))
        rows, broken = out.rows, True
    return rows, broken


# ---- Python ---------------------------------------------------------------------------------------
def _python(text: str, lines: list[str], max_chars: int) -> tuple[list[dict], bool]:
    tree = ast.parse(text)
    found = [t for t in tokenize.generate_tokens(io.StringIO(text).readline)]
    drop = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
    comments = [t.start[0] for t in found if t.type == tokenize.COMMENT and not t.line[:t.start[1]].strip()]
    out = Rows(lines, [(t.start[0], t.string) for t in found if t.type not in drop], max_chars)
    defs = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def start_of(node) -> int:
        return min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])

    def inner(node) -> list:
        return [s for f in ("body", "handlers", "orelse", "finalbody", "cases") for s in getattr(node, f, []) or []
                if isinstance(s, (ast.stmt, ast.ExceptHandler, ast.match_case))]

    def block(nodes: list, parent: int, qual: str, in_class: bool, low: int, high: int) -> None:
        flat = []
        for n in nodes:
            flat.extend(n.body if isinstance(n, (ast.ExceptHandler, ast.match_case)) else [n])
        spans = [(start_of(n), n.end_lineno, n) for n in flat]
        spans += [(c, c, None) for c in comments if low <= c <= high and not any(s <= c <= e for s, e, _ in spans)]
        for start, end, node in sorted(spans, key=lambda x: x[:2]):
            if node is None:
                out.close(out.add(parent, "comment", "", "", start, end))
                continue
            if not isinstance(node, defs):
                row = out.add(parent, "statement", "", "", start, end)
                if end > start:
                    block(inner(node), row["id"], qual, False, start, end)
                out.close(row)
                continue
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
            name = f"{qual}.{node.name}" if qual else node.name
            first = node.body[0]
            head = "\n".join(lines[start - 1:start_of(first) - 1]) or lines[start - 1][:first.col_offset]
            row = out.add(parent, kind, node.name, name, start, end, head)
            if kind == "class":
                out.header(row, next((start_of(m) for m in node.body if isinstance(m, defs)), None))
            block(node.body, row["id"], name, kind == "class", start + 1, end)
            out.close(row)

    block(tree.body, -1, "", False, 1, len(lines))
    return out.rows, False


# ---- JavaScript and TypeScript ---------------------------------------------------------------------
_LEX = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<regex>(?:(?<=[=(,:;!&|?{}\[])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=\bin)|(?<=\bof)|(?<=\bdelete)|(?<=\bvoid)|(?<=\bthrow)|(?<=\bawait)|(?<=\byield)|(?<=\belse)|(?<=\bdo)|(?<=^))\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
    r"|(?P<word>[\w$#@]+)|(?P<mark>=>|\.\.\.|[-+*/%&|^<>=!?]+|[^\s\w])", re.S)
_PAIRS = {"{": "}", "(": ")", "[": "]"}
_BLOCKS = {"function", "class", "if", "for", "while", "switch", "try", "do", "interface", "namespace", "enum", "with"}
_GOES_ON = {"else", "catch", "finally", "instanceof", "in", "of", "as", "satisfies", "extends", "implements"}


def _braces(text: str, lines: list[str], max_chars: int) -> tuple[list[dict], bool]:
    tokens, comments, line, at = [], [], 1, 0
    for m in _LEX.finditer(text):
        found, kind, start = m.group(), m.lastgroup, m.start()
        if kind == "regex":  # begins with the white space before it
            found, start = found.lstrip(), m.end() - len(found.lstrip())
        line, at = line + text.count("\n", at, start), start
        end = line if kind in ("word", "mark") else line + found.count("\n")
        if kind == "comment":
            comments.append((line, end, start))
        else:
            tokens.append((found, line, end, start))
    match, stack, broken = {}, [], False
    for i, (t, *_) in enumerate(tokens):
        if t in _PAIRS:
            stack.append(i)
        elif t in _PAIRS.values():
            if stack and _PAIRS[tokens[stack[-1]][0]] == t:
                match[stack.pop()] = i
            else:
                broken = True
    broken = broken or bool(stack)
    out = Rows(lines, [(n, t) for t, n, _, _ in tokens], max_chars)

    def word(i: int, b: int) -> str:
        return tokens[i][0] if i < b else ""

    def statement_end(i: int, b: int, in_class: bool) -> int:
        j, first = i, i
        while word(first, b) in ("export", "default", "async", "abstract", "declare"):
            first += 1
        blockish = word(first, b) in _BLOCKS
        while j < b:
            closes = match.get(j)
            j = (closes if closes is not None and closes < b else j) + 1
            done, nxt = tokens[j - 1][0], word(j, b)
            if done == ";" or j >= b:
                break
            if done == "}" and (blockish or (in_class and "=" not in [tokens[k][0] for k in range(i, j)])) and nxt not in _GOES_ON \
                    and not (word(first, b) == "do" and nxt == "while"):
                return j + (nxt == ";")
            fresh = tokens[j][1] > tokens[j - 1][2]
            ends_open = re.fullmatch(r"[-+*/%&|^<>=!?,.:(\[{]+|=>", done) or done in _GOES_ON or done in ("return", "new", "=")
            if fresh and not ends_open and not re.match(r"[-+*/%&|^<>=?,.:(\[)\]{]", nxt) and nxt not in _GOES_ON:
                break
        return j

    def function_value(i: int, b: int) -> int | None:
        """Index of the body of a function or arrow that starts at i, b when it has no braces, None when it is neither."""
        i += word(i, b) == "async"
        if word(i, b) == "function":
            return next((k for k in _top(i, b) if tokens[k][0] == "{"), b)
        arrow = next((k for k in _top(i, b) if tokens[k][0] == "=>"), None)
        if arrow is None or any(tokens[k][0] in ("=", ",", "?", "&&", "||") for k in _top(i, arrow)):
            return None
        return arrow + 1 if word(arrow + 1, b) == "{" else b

    def _top(i: int, b: int):
        while i < b:
            yield i
            i = match.get(i, i) + 1

    def classify(i: int, b: int, in_class: bool) -> tuple[str, str, str, int] | None:
        """(kind, name, qualified part, index of the body) of the statement i..b, or None."""
        exported = word(i, b) == "export"
        while word(i, b) in ("export", "default", "declare", "abstract") or word(i, b).startswith("@"):
            i = match.get(i + 1, i) + 1 if word(i, b).startswith("@") and word(i + 1, b) == "(" else i + 1
        brace = next((k for k in _top(i, b) if tokens[k][0] == "{"), None)
        start = i + (word(i, b) == "async")
        if word(start, b) == "function" and (exported or not in_class):
            name = next((tokens[k][0] for k in range(start + 1, min(start + 3, b)) if re.match(r"[\w$]", tokens[k][0])), "default")
            return ("function", name, name, brace if brace is not None else b) if brace is not None else None
        if word(i, b) == "class" and brace is not None:
            name = word(i + 1, b) if word(i + 1, b) not in ("{", "extends") else "default"
            return "class", name, name, brace
        if in_class:
            k = i
            while word(k, b) in ("static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override") and word(k + 1, b) not in ("(", "="):
                k += 1
            name = word(k, b)
            equals = next((e for e in _top(k, b) if tokens[e][0] == "="), None)
            if equals is not None and (brace is None or equals < brace):
                body = function_value(equals + 1, b - (word(b - 1, b) == ";"))
                return ("method", name, name, body) if body is not None else None
            return ("method", name, name, brace) if brace is not None and any(tokens[e][0] == "(" for e in _top(k, brace)) else None
        stop = b - (word(b - 1, b) == ";")
        equals = next((e for e in _top(i, stop) if tokens[e][0] == "="), None)
        if equals is not None:
            body = function_value(equals + 1, stop)
            if body is not None and word(i, b) in ("const", "let", "var") and not any(tokens[e][0] == "," for e in _top(i, equals)):
                return "function", word(i + 1, b), word(i + 1, b), body
            if body is not None and all(re.match(r"[\w$.\[]", tokens[e][0]) for e in _top(i, equals)) and word(i, b) not in ("const", "let", "var"):
                left = _SPACE.sub("", text[tokens[i][3]:tokens[equals][3]])
                return ("method" if ".prototype." in left else "function"), left.split(".")[-1], left, body
        elif exported and function_value(i, stop) is not None:
            return "function", "default", "default", function_value(i, stop)
        return None

    def block(a: int, b: int, parent: int, qual: str, in_class: bool, low: int, high: int) -> None:
        found, i = [], a
        while i < b:
            e = max(statement_end(i, b, in_class), i + 1)
            if any(t[0] not in ";,)]}" for t in tokens[i:e]):
                found.append((tokens[i][1], tokens[e - 1][2], i, e))
            i = e
        found += [(s, e, -1, p) for s, e, p in comments if low <= p < high and not any(tokens[x[2]][3] <= p < tokens[x[3] - 1][3] for x in found if x[2] >= 0)]
        for start, end, i, e in sorted(found, key=lambda x: (x[0], x[3] if x[2] < 0 else tokens[x[2]][3])):
            if i < 0:
                out.close(out.add(parent, "comment", "", "", start, end))
                continue
            what = classify(i, e, in_class)
            if what is None:
                row = out.add(parent, "statement", "", "", start, end)
                k = i
                while k < e and end > start:  # the blocks inside, at whatever nesting of other brackets
                    if tokens[k][0] == "{" and k in match:
                        block(k + 1, match[k], row["id"], qual, False, tokens[k][3], tokens[match[k]][3])
                        k = match[k]
                    k += 1
                out.close(row)
                continue
            kind, name, local, body = what
            name_q = f"{qual}.{local}" if qual else local
            row = out.add(parent, kind, name, name_q, start, end, text[tokens[i][3]:tokens[body][3] if body < e else tokens[e - 1][3] + 1])
            if body < e and body in match:
                inside = (body + 1, match[body])
                if kind == "class":
                    k, first = inside[0], None
                    while k < inside[1] and first is None:
                        stop = max(statement_end(k, inside[1], True), k + 1)
                        first, k = (tokens[k][1] if classify(k, stop, True) else None), stop
                    out.header(row, first)
                block(*inside, row["id"], name_q, kind == "class", tokens[body][3], tokens[inside[1]][3])
            out.close(row)

    block(0, len(tokens), -1, "", False, 0, len(text) + 1)
    return out.rows, broken
