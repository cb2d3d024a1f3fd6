"""What one line means, character by character in plain Python; the tests' yardstick."""

import re

SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_S, _N = f"[{SPACE}]", f"[^{SPACE}]"
COMBINED = re.compile(
    rf'^({_N}+){_S}+{_N}+{_S}+{_N}+{_S}+\[([^\]]+)\]{_S}+"([^"]*)"{_S}+(\d{{3}}){_S}+({_N}+)'
    rf'{_S}+"[^"]*"{_S}+"([^"]*)"'
)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def number(token):
    if re.fullmatch(r"\+?[0-9]+", token, re.ASCII):
        digits = token.lstrip("+0")
        if len(digits) <= 20 and int(digits or 0) < 2**64:
            return int(digits or 0)
    return 0


def path_of(request):
    words = [w for w in re.split(f"{_S}+", request) if w]
    return words[1] if len(words) > 1 else "-"


def record(ip, timestamp, request, status, size, agent):
    exact = number(size)
    return {
        "ip": ip,
        "path": path_of(request),
        "user_agent": agent,
        "status_code": status,
        "traffic_bytes": exact,
        "timestamp_str": timestamp,
    }


def by_delimiters(line):
    line = line.rstrip("\r")
    ip, space, rest = line.partition(" ")
    if not space:
        return None
    _, bracket, rest = rest.partition("[")
    timestamp, closing, rest = rest.partition("]")
    if not bracket or not closing:
        return None
    _, quote, rest = rest.partition('"')
    request, end_quote, rest = rest.partition('"')
    if not quote or not end_quote:
        return None
    parts = rest.lstrip(SPACE).split(" ", 2)
    if len(parts) < 3:
        return None
    quoted = parts[2].split('"')
    if len(quoted) < 3:
        return None
    return record(ip, timestamp, request, parts[0], parts[1], quoted[3] if len(quoted) > 3 else "-")


def by_pattern(line):
    found = COMBINED.match(line)
    return record(*found.groups()) if found else None


def parse(line):
    return by_delimiters(line) or by_pattern(line)


def buckets(timestamp):
    raw = timestamp.encode()
    if len(raw) < 14:
        return None
    try:
        day, month, year, hour = (raw[a:b].decode() for a, b in ((0, 2), (3, 6), (7, 11), (12, 14)))
    except UnicodeDecodeError:
        return None
    if month not in MONTHS:
        return None
    date = f"{year}-{MONTHS.index(month) + 1:02d}-{day}"
    return f"{date} {hour}:00", date, date[: len(year) + 3]
