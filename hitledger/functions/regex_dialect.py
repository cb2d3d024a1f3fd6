"""Translate the users' group patterns and templates to the dialect of Spark's regex functions.

Users write patterns of a linear-time dialect without look-around and back-references. Most of it
means the same to Java; what differs is rewritten here, once per rule on the driver, and what has
no counterpart is refused.
"""

from __future__ import annotations

import re

# Escapes that mean the same in both dialects.
_SAME_ESCAPES = set("dDsSwWbBAztnrfa")

# Operators between the sets of a character class.
_SET_OPERATORS = ("&&", "--", "~~")

# Bracket names inside character classes; ASCII only, whatever the flags.
_BRACKET_NAMES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t-\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

_NAMED_GROUP = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>")
_FLAG_GROUP = re.compile(r"\(\?([A-Za-z-]*)([:)])")
_HEX = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|[xuU]\{([0-9A-Fa-f]+)\})")
_PROPERTY = re.compile(r"\\([pP])(?:([A-Za-z])|\{(\^?)([^}]*)\})")
_BRACKET_NAME = re.compile(r"\[:(\^?)([a-z]+):\]")
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??")


class UnsupportedPattern(ValueError):
    """The pattern is not valid, or not expressible, in the supported dialect."""


class Translated:
    """A pattern in Java form and its groups, by number and by name."""

    def __init__(self, pattern: str):
        self.group_names: dict[str, int] = {}
        self.groups = 0
        self.flags: set[str] = set()
        body = self._translate(pattern)
        # d: only a line feed ends a line; U: classes follow Unicode. An empty match right after
        # the previous match does not count, except at the start of the text; the atomic group
        # keeps the condition from steering the pattern to another match.
        self.java = rf"(?dU)(?>{body})(?:(?!\G)|\A)"

    def _translate(self, pattern: str) -> str:
        out: list[str] = []
        at = 0
        classes: list[list[int]] = []  # where in out each open class begins and its set operators stand
        opened: list[int] = []  # where in out each open group begins
        closed: int | None = None  # the same of a group that ends right here
        while at < len(pattern):
            before, closed = closed, None
            char = pattern[at]
            if char == "\\":
                text, at = _escape(pattern, at, bool(classes))
                out.append(text)
            elif char == "[":
                text, at, opens = _open_class(pattern, at, bool(classes))
                if opens:
                    classes.append([len(out)])
                out.append(text)
            elif classes:
                operator = pattern[at : at + 2] if pattern.startswith(_SET_OPERATORS, at) else ""
                if operator:
                    classes[-1].append(len(out))
                out.append(operator or char)
                at += len(out[-1])
                if char == "]":
                    start, *operators = classes.pop()
                    if any(out[i] in ("--", "~~") for i in operators):
                        out[start:] = [_class_of_sets(out[start:], [i - start for i in operators])]
            elif char == "(":
                text, at = self._open_group(pattern, at)
                if text.startswith("(?") and text.endswith(")"):  # flags alone open nothing
                    self.flags |= set(text)
                else:
                    opened.append(len(out))
                    self.flags |= set(text[2:].split("-")[0]) if text.startswith("(?") else set()
                out.append(text)
            elif char == ")":
                closed = opened.pop() if opened else None
                out.append(char)
                at += 1
            elif quantifier := _QUANTIFIER.match(pattern, at):
                at = quantifier.end()
                if _QUANTIFIER.match(pattern, at):
                    raise UnsupportedPattern("a quantifier cannot follow a quantifier")
                if before is not None and _repeats_long(quantifier.group()):
                    out[before:] = [self._repeated_group(out[before:], quantifier.group())]
                else:
                    out.append(quantifier.group())
            else:
                out.append(char)
                at += 1
        return "".join(out)

    def _open_group(self, pattern: str, at: int) -> tuple[str, int]:
        if not pattern.startswith("(?", at):
            self.groups += 1
            return "(", at + 1
        if named := _NAMED_GROUP.match(pattern, at):
            self.groups += 1
            if named[1] in self.group_names:
                raise UnsupportedPattern(f"duplicate group name {named[1]}")
            self.group_names[named[1]] = self.groups
            return "(", named.end()
        if flags := _FLAG_GROUP.match(pattern, at):
            if extra := set(flags[1]) - set("imsxu-"):
                raise UnsupportedPattern(f"flag {''.join(sorted(extra))} is not supported")
            if "u" in flags[1].partition("-")[2]:
                raise UnsupportedPattern("Unicode cannot be turned off")
            kept = flags[1].replace("u", "")  # always on
            return f"(?{kept.removesuffix('-')}{flags[2]}" if kept or flags[2] == ":" else "", flags.end()
        raise UnsupportedPattern("look-around is not supported")

    def _repeated_group(self, parts: list[str], quantifier: str) -> str:
        """A repeated group without Java's recursion, which a long text would take too deep.

        A group of alternative single characters is a class, and that repeats without recursion; a
        capturing one holds the last character. Other groups have no such form.
        """
        opening, body, lazy = parts[0], parts[1:-1], quantifier[1:2] == "?" or quantifier.endswith("}?")
        body = _classes_joined(body)
        choices = body[::2]
        single = len(body) % 2 and all(x == "|" for x in body[1::2]) and all(map(_is_one_character, choices))
        if not single or "x" in self.flags or "s" in self.flags:
            raise UnsupportedPattern(
                "only groups of single characters can be repeated without end;"
                f" repeat this one {{1,{_FEW}}} times, or write a class of characters"
            )
        one = "[" + "".join("[^\\n]" if x == "." else x for x in choices) + "]"
        if opening.startswith("(?"):
            return one + quantifier
        if lazy:
            raise UnsupportedPattern("a capturing group cannot be repeated lazily without end")
        if quantifier == "+":
            return f"{one}*({one})"
        if quantifier == "*":
            return f"(?:{one}*({one}))?"
        raise UnsupportedPattern("a capturing group cannot be repeated that often")

    def java_template(self, template: str) -> str:
        """Replacement text: ``$1``, ``$name``, ``${name}``, ``$$``; unknown groups are empty."""
        out: list[str] = []
        at = 0
        while at < len(template):
            reference = re.compile(r"\$(?:([0-9A-Za-z_]+)|\{([^}]*)\})").match(template, at)
            if reference:
                out.append(self._group_reference(reference[1] or reference[2] or ""))
                at = reference.end()
                continue
            if template.startswith("$$", at):
                at += 1
            char = template[at]
            # an escaped digit cannot be taken as part of the group number before it
            out.append("\\" + char if char in "\\$0123456789" else char)
            at += 1
        return "".join(out)

    def _group_reference(self, name: str) -> str:
        number = int(name) if re.fullmatch(r"[0-9]+", name) else self.group_names.get(name)
        return "" if number is None or number > self.groups else f"${number}"


#: A group repeated up to this often cannot exhaust a stack.
_FEW = 64


def _repeats_long(quantifier: str) -> bool:
    if quantifier[0] in "*+":
        return True
    bounds = quantifier.strip("{}?").split(",") if quantifier[0] == "{" else ["1"]
    return bounds[-1] == "" or int(bounds[-1]) > _FEW


def _class_of_sets(parts: list[str], operators: list[int]) -> str:
    """A class with differences as one of intersections: from left to right, as all operators bind alike."""
    opening = "[^" if parts[0].startswith("[^") else "["
    edges = [0, *operators, len(parts) - 1]
    operands = ["".join(parts[a + 1 : b]) for a, b in zip(edges, edges[1:])]
    operands[0] = parts[0].removeprefix(opening) + operands[0]
    if not all(operands):
        raise UnsupportedPattern("a set operator needs characters on both sides")
    left = f"[{operands[0]}]"
    for at, operand in zip(operators, operands[1:]):
        right, inverse = f"[{operand}]", f"[^{operand}]"
        if parts[at] == "&&":
            left = f"[{left}&&{right}]"
        elif parts[at] == "--":
            left = f"[{left}&&{inverse}]"
        else:
            left = f"[[{left}&&{inverse}][{right}&&[^{left}]]]"
    return f"{opening}{left}]"


def _classes_joined(parts: list[str]) -> list[str]:
    """The parts of a group with each bracketed class as one part."""
    out, depth = [], 0
    for part in parts:
        if depth:
            out[-1] += part
        else:
            out.append(part)
        if part.startswith("[") and not part.endswith("]"):
            depth += 1
        elif depth and part == "]":
            depth -= 1
    return out


def _is_one_character(part: str) -> bool:
    if part.startswith("["):
        return part.endswith("]")
    if part.startswith("\\"):
        return part[1] not in "bBAzZGbQEkR" and not part.startswith(r"\b")
    return len(part) == 1 and part not in "^$()*+?{"


def _escape(pattern: str, at: int, in_class: bool) -> tuple[str, int]:
    following = pattern[at + 1 : at + 2]
    if not following:
        raise UnsupportedPattern("the pattern ends in a backslash")
    if code := _HEX.match(pattern, at):
        return rf"\x{{{next(filter(None, code.groups()))}}}", code.end()
    if prop := _PROPERTY.match(pattern, at):
        negated = (prop[1] == "P") != bool(prop[3])
        return rf"\{'P' if negated else 'p'}{{{_property_name(prop[2] or prop[4])}}}", prop.end()
    if following == "v":
        return r"\x0B", at + 2
    if following in "<>" and not in_class:
        return (r"\b(?=\w)" if following == "<" else r"\b(?<=\w)"), at + 2
    if following == "b" and pattern.startswith("{", at + 2):
        raise UnsupportedPattern("special word boundaries are not supported")
    if following in _SAME_ESCAPES or (following.isascii() and not following.isalnum()):
        return "\\" + following, at + 2
    raise UnsupportedPattern(f"escape \\{following} is not supported")


def _property_name(name: str) -> str:
    """General categories keep their name; scripts and other properties need a prefix in Java."""
    return name if len(name) <= 2 or "=" in name else f"Is{name}"


def _open_class(pattern: str, at: int, nested: bool) -> tuple[str, int, int]:
    """Java text for a ``[`` (with what must directly follow it), next position, depth change."""
    if nested and (bracket := _BRACKET_NAME.match(pattern, at)):
        if bracket[2] not in _BRACKET_NAMES:
            raise UnsupportedPattern(f"unknown character class [:{bracket[2]}:]")
        return f"[{bracket[1]}{_BRACKET_NAMES[bracket[2]]}]", bracket.end(), 0
    text, at = "[", at + 1
    if pattern.startswith("^", at):
        text, at = "[^", at + 1
    if pattern.startswith("]", at):
        text, at = text + r"\]", at + 1
    return text, at, 1
