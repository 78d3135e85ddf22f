"""Credentials embedded in source code and configuration: find them and splice redactions into the original text.

Configuration formats are parsed into key paths with the offsets of their values; in other text the literals behind
names, in calls, addresses, headers and remarks are looked at. A finding is the offset range of the secret itself, so a
redaction replaces these characters only and leaves quotes, keys and line ends as they are.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codectx.llm.common import crossfile_entries, spread

#: Words that make a name sensitive, by themselves or next to each other. Fixed values.
WORDS = frozenset(
    "password passwd passwort passphrase passcode pwd pass pw secret secrets token apikey credential credentials contrasena contraseña kennwort senha motdepasse mdp haslo hasło wachtwoord lozinka parol пароль".split()
)
PHRASES = (("api", "key"), ("access", "key"), ("signing", "key"), ("private", "key"), ("secret", "key"), ("auth", "key"), ("encryption", "key"), ("master", "key"), ("mot", "de", "passe"))
#: Words that say the value is no secret though the name has one of the above.
HARMLESS = frozenset("sha sha1 sha256 sha512 md5 digest checksum revision commit uuid hash public pub fingerprint etag count limit type length len size max min name file path env hint field column label title expiry expires ttl url uri endpoint id ids index pattern regex format".split())
PLACEHOLDER = re.compile(
    r"(?i)(?:change[-_ ]?me|(.)\1*|x{3,}.*|\*+|\.+|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|(?:pass|password|passwd|secret|token|key|user|username|none|null|nil|true|false|undefined|todo|tbd|fixme|dummy|example|sample|placeholder|redacted|removed|hidden|empty|string|default|test|insert.*here|replace.*)(?:\d{0,3}))"
)
LOOKUP = re.compile(r"<[^<>]*>|\$\{|\$\(|\{\{|%\(|%[A-Z_]+%|\$[A-Z_]{2,}$|#\{|@@|os\.environ|process\.env|getenv|vault[.:/]")
SPECIAL = frozenset("!?*#%+&@^~$=")
WORD_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿа-я]+|\d+")
CONFIG = re.compile(r"(?i)\.(env|ini|cfg|conf|cnf|properties|ya?ml|json|toml|tf|tfvars|hcl|xml|config|plist|xaml|sh|bash|zsh|envrc|dockerfile)$|(?:^|/)\.env(?:\.\w+)?$|(?:^|/)\.?(?:npmrc|pypirc|netrc)$|(?:^|/)(dockerfile|containerfile)(?:\.\w+)?$")
XML, SHELL, DOCKER = frozenset("xml config plist xaml".split()), frozenset("sh bash zsh envrc".split()), frozenset("dockerfile containerfile".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([\w:.-]+)((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/?)>""", re.S)
ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
#: An assignment of a shell or a container file, and one that is an item of a list.
SHELL_VALUE = re.compile(r"""(?m)(?:^[ \t]*|(?<=[;&|][ \t])|\b(?:export|local|readonly|declare|env)[ \t]+)([A-Za-z_]\w*)=(?:"((?:\\.|[^"\\\n])*)"|'([^'\n]*)'|([^\s"'`;&|<>()]+))""")
DOCKER_LINE, DOCKER_PAIR = re.compile(r"(?im)^[ \t]*(?:ENV|ARG|LABEL)[ \t]+((?:\\\r?\n|[^\n])*)"), re.compile(r"""([A-Za-z_][\w.-]*)=(?:"((?:\\.|[^"\\])*)"|'([^']*)'|((?:\\.|[^\s"'\\])+))""")
OLD_ENV = re.compile(r"([A-Za-z_]\w*)[ \t]+([^\s=]\S*)[ \t]*\Z")
ITEM_PAIR = re.compile(r"([A-Za-z_]\w*)=(?=\S)")

KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BODY = re.compile(r"""(?:\\r|\\n|["'`+\s\\,]|#|//|(?:Proc-Type|DEK-Info|Version|Comment)[^\n]*)*[A-Za-z0-9+/=]{16,}|\s*\Z""")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://([^\s:/@\"'`<>{}$]{1,64}):([^\s/@\"'`]+)@([^\s\"'`/<>]+)")
HEADER = re.compile(r"\b(?:(Basic) +([A-Za-z0-9+/_-]{8,}={0,2})|(Bearer|Token) +([A-Za-z0-9._~+/=-]{16,}))")
#: A short prefix and a long random rest, as issuers of tokens write them: the rest, and what stands before it.
RANDOM = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{14,}(?![\w/+-])")
PREFIX = re.compile(r"(?<![\w/.+-])(?!sha\d|md5|rev|v\d)[A-Za-z][A-Za-z0-9]{1,7}(?:[-_.][a-z]{2,6})?[-_.]\Z")
ASSIGNED = re.compile(r"""(?:["'`]([\w.$ -]{1,64})["'`]|([A-Za-z_$\u00c0-\u04ff][\w.$-]{0,80}))[ \t]*\]?[ \t]*(?::[ \t]*[\w<>\[\], ?.|]{1,40}?[ \t]*=|=>|:=|=(?!=)|:)[ \t]*([rbuRBU]{0,2})(\"{3}|'{3}|["'`])""")
JOINED = re.compile(r"""(?:\s*(?:\+|\.\.?)(?:\s|\\\n)*|[ \t]*\\\n[ \t]*|[ \t]+)[rbu]?(?!\"{3}|'{3})(["'`])""")
CALL = re.compile(r"(?i)\b(?:\w+\.)*\w*(?:connect|login|log_in|authenticate|sign_?in|auth|credentials?|set_?password|set_?pass|with_?password)\w*\s*\(([^()\n]{3,}+)")
STRING = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
#: A name before an argument; values of hosts, paths, ids and words with numbers, which by their shape might be secrets.
NAMED = re.compile(r"(\w+)[\"']?\s*[=:]\s*\Z")
NAMELIKE = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}|[^@]+@[\w-]+\.[\w.-]+|[\w.-]+(?:/[\w.-]+)+\.\w{1,5}|[a-z]+/[a-z0-9.+-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[a-z]++\d{0,4}+(?:[-_.](?:[a-z]++\d{0,4}+|\d{1,4}+))*+|[A-Z]*[a-z]+(?:[A-Z][a-z]+)*\d{0,4}")
REMARK = re.compile(r"(?:^|(?<=[\s;{})]))(?:#|//|/\*+|--|;|<!--|\*)[ \t]*|\"{3}")
#: The marks of remarks on a line too long to have been typed, where most of these characters are operators, selectors or separators.
LONG, LONG_REMARK = 2000, re.compile(r"(?:^|(?<=[\s;{})]))(?://|/\*+|<!--|(?:#|--)(?=[ \t])|(?:^|(?<=\s))#)[ \t]*|^(?:--|;|\*)[ \t]*|\"{3}")
REMARK_END = {"/*": "*/", "<!": "-->", '""': '"""'}
REMARK_VALUE = re.compile(r"[^\s\"'`,;()]+")
NO_SECRET = re.compile(r"(?i)\b(?:sha-?\d*|md5|checksum|revision|commit|uuid|id)\W*\Z")
REMARK_WORD = re.compile(r"(?i)(?<![\w-])(?:pw|pwd|pass|password|passwd|passwort|kennwort|passphrase|contraseña|contrasena|mot de passe|mdp|senha|hasło|login|log ?in|creds?|credentials?|secret|api[- ]?key|token|key|x-[a-z-]*(?:token|key)|auth)s?(?![\w])")
#: A line with none of these, in lower case, holds no sensitive name, call or remark. Fixed values.
TRIGGERS = ("pass", "pwd", "pw ", "pw:", "pw=", "secret", "token", "key", "cred", "contrase", "kennw", "mot de", "mot_de", "motde", "mdp", "senha", "has\u0142o", "haslo", "wachtw", "lozink", "parol", "\u043f\u0430\u0440\u043e\u043b", "login", "log in", "log_in", "auth", "sign", "connect")


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str
    key: str


def words_of(name: str) -> list[str]:
    return [w.lower() for w in WORD_SPLIT.findall(name)]


def sensitive(name: str) -> int:
    """2: the name asks for a secret; 1: it only ends in 'key', so the value must look like one; 0: neither.

    >>> [sensitive(x) for x in ("dbPassword", "DB_PASS_A", "parcel_key", "token_count", "user")]
    [2, 2, 1, 0, 0]
    """
    words = words_of(name)
    hits = [k for k, w in enumerate(words) if w in WORDS]
    hits += [k + len(p) - 1 for p in PHRASES for k in range(len(words) - len(p) + 1) if tuple(words[k : k + len(p)]) == p]
    if hits:
        return 0 if any(w in HARMLESS for w in words[max(hits) + 1 : max(hits) + 2]) or any(w in ("sha", "sha256", "md5", "public", "pub", "next", "max", "min", "num") for w in words) else 2
    return 1 if words and words[-1] == "key" and not any(w in HARMLESS for w in words[-2:]) else 0


def literal(value: str) -> bool:
    """Whether a value stands for itself: no placeholder and no lookup of something outside."""
    v = value.strip()
    return len(v) >= 6 and not LOOKUP.search(v) and not PLACEHOLDER.fullmatch(v)


def chosen(value: str) -> bool:
    """Whether a literal behind a sensitive name looks like a secret: a digit, mixed case or a special character, no sentence."""
    return literal(value) and not re.search(r"\s", value) and bool(re.search(r"\d|[a-z][A-Z]|[A-Z]{2}[a-z]", value) or SPECIAL & set(value) or len(value) >= 20)


def strong(value: str) -> bool:
    """Whether a literal looks like a secret wherever it stands."""
    if not literal(value) or len(value) < 8 or re.search(r"[\s(){}\[\]<>:;,]|^/|//", value) or not re.search(r"[A-Za-z]", value):
        return False
    mixed = bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value))
    if re.search(r"\d", value):
        return mixed or bool(SPECIAL & set(value)) or len(value) >= 16 and "_" not in value
    return mixed and len(value) >= 12 and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) >= 2 and value.isalnum()


def issued(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of tokens that show what they are by themselves: behind an issuer's prefix, or long and random in a remark."""
    for m in RANDOM.finditer(text):
        at = m.start()
        if m.end() - at >= 20 and re.search(r"\d", rest := m.group()) and re.search(r"[a-z]", rest) and re.search(r"[A-Z]", rest) and (at == 0 or text[at - 1] in " \t:="):
            line = text.rfind("\n", 0, at) + 1
            stop = text.find("\n", at)
            here = text[line : stop if stop >= 0 else len(text)]
            if any(s <= at - line < e for s, e in remarks(here)) and not NO_SECRET.search(text, max(line, at - 64), at):
                yield m.span()
                continue
        if at and text[at - 1] in "-_." and re.search(r"\d", rest := m.group()) and re.search(r"[a-z]", rest) and re.search(r"[A-Z]", rest):
            if p := PREFIX.search(text, max(0, at - 18), at):
                yield p.start(), m.end()


def marked_lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that hold a trigger."""
    low = text.lower()
    if len(low) != len(text):  # a few characters grow in lower case, which would shift offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = set()
    for w in TRIGGERS:
        k = low.find(w)
        while k >= 0:
            end = low.find("\n", k)
            end = len(low) if end < 0 else end
            out.add((low.rfind("\n", 0, k) + 1, end))
            k = low.find(w, end)
    return sorted(out)


def basic_login(text: str) -> bool:
    try:
        raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if re.search("[-_]", text) else None)
        name, mark, secret = raw.decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError):
        return False
    return bool(mark and name and secret and (name + secret).isprintable() and literal(secret))


def _closing(text: str, at: int, quote: str) -> int:
    """Where the literal that began before ``at`` ends; the end of the text (or line) if it isn't closed."""
    k = at
    while k < len(text):
        if text[k] == "\\":
            k += 2
        elif text.startswith(quote, k):
            return k
        elif text[k] == "\n" and quote in "\"'":
            return k
        else:
            k += 1
    return len(text)


FLOW = re.compile(r"""\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|(?<=\s)\#[^\n]*|[{}\[\],]|:(?=[\s,{}\[\]"']|\Z)|(?:[^\s{}\[\],:]|:(?![\s,{}\[\]"']|\Z))+""")
BLOCK = re.compile(r"(?:[!&]\S*\s+)*[|>](?:[+-]?\d?|\d[+-])(?:\s+#.*)?")
ITEM = re.compile(r"(\s*)((?:-\s+)+)")


def flow_values(text: str, at: int, stop: int) -> tuple[list[tuple[str, int, int]], int]:
    """([(key path, start, end)] of a YAML flow map or sequence that begins at ``at``, where it ends); the end is -1 if it isn't closed.

    >>> [(k, "{a: x, b: [y]}"[s:e]) for k, s, e in flow_values("{a: x, b: [y]}", 0, 14)[0]]
    [('a', 'x'), ('b', 'y')]
    """
    out: list[tuple[str, int, int]] = []
    stack: list[str] = []
    name, here = "", None  # here: the scalar that is being read
    for t in FLOW.finditer(text, at, stop):
        g = t.group()
        if g == ":" and here:
            name, here = text[here[0] : here[1]], None
        elif g[0] in "{[":
            stack.append(name)
            name, here = "", None
        elif g[0] in "}],":
            if here:
                out.append((".".join(x for x in (*stack, name) if x), *here))
            here, name = None, ""
            if g != ",":
                stack.pop()
                if not stack:
                    return out, t.end()
        elif g[0] != "#" and g != ":":
            quoted = len(g) > 1 and g[0] == g[-1] and g[0] in "\"'"
            here = (t.start() + 1, t.end() - 1) if quoted else (here[0] if here else t.start(), t.end())
    return out, -1


def xml_values(text: str) -> list[tuple[str, int, int]]:
    """[(key path, start, end)] of the attributes and texts of an XML text. An attribute 'value' goes by what 'name' or 'key' beside it says, a text by the ``<key>`` before it.

    >>> [(k, "<a><b p='x'>y</b></a>"[s:e]) for k, s, e in xml_values("<a><b p='x'>y</b></a>")]
    [('a.b.p', 'x'), ('a.b', 'y')]
    """
    out: list[tuple[str, int, int]] = []
    stack: list[str] = []
    at, spoken = -1, ""  # where the text behind an opening tag begins; the last text of a <key>
    for m in TAG.finditer(text):
        if m.group(1) is not None:
            if stack and m.group(1).strip():
                out.append((".".join(stack), *m.span(1)))
            at = -1
        elif m.group(3):
            if m.group(2):
                if at >= 0 and stack and stack[-1] == m.group(3) and (inner := text[at : m.start()]).strip():
                    s = at + len(inner) - len(inner.lstrip())
                    e = at + len(inner.rstrip())
                    if m.group(3).lower() == "key":
                        spoken = text[s:e]
                    else:
                        out.append((".".join([*stack, spoken] if spoken else stack), s, e))
                        spoken = ""
                while stack and stack.pop() != m.group(3):
                    pass
                at = -1
            else:
                found = {t.group(1).lower(): t.span(2) if t.group(2) is not None else t.span(3) for t in ATTRIBUTE.finditer(text, *m.span(4))}
                named = next((text[slice(*found[k])] for k in ("name", "key", "id") if k in found), "")
                out += [(".".join([*stack, m.group(3), named if k == "value" and named else k]), s, e) for k, (s, e) in found.items()]
                if not m.group(5):
                    stack.append(m.group(3))
                    spoken = spoken or (named if "value" not in found else "")
                    at = m.end()
    return out


def config_values(path: str, text: str) -> list[tuple[str, int, int]]:
    """[(key path, start, end)] of the values of a configuration text; quotes stand outside of the ranges.

    >>> [(k, "a:\\n  pw: \\"x1\\"\\n"[s:e]) for k, s, e in config_values("c.yaml", "a:\\n  pw: \\"x1\\"\\n")]
    [('a.pw', 'x1')]
    """
    m = CONFIG.search(path)
    kind = (m.group(1) or m.group(2) or "env").lower() if m else ""
    out: list[tuple[str, int, int]] = []
    if kind in XML:
        return xml_values(text)
    if kind in SHELL:
        return [(t.group(1), *next(t.span(k) for k in (2, 3, 4) if t.group(k) is not None)) for t in SHELL_VALUE.finditer(text)]
    if kind in DOCKER:
        for line in DOCKER_LINE.finditer(text):
            pairs = list(DOCKER_PAIR.finditer(text, line.start(1), line.end(1)))
            out += [(t.group(1), *next(t.span(k) for k in (2, 3, 4) if t.group(k) is not None)) for t in pairs]
            if not pairs and (t := OLD_ENV.match(text, line.start(1), line.end(1))):
                out.append((t.group(1), *t.span(2)))
        return out
    if kind == "json":
        stack: list[str] = []
        name = ""
        for t in re.finditer(r'"((?:\\.|[^"\\])*)"(\s*:)?|[{}\[\],]|[^\s{}\[\],":]+', text):
            g = t.group()
            if t.group(2):
                name = t.group(1)
            elif g[0] in "{[":
                stack.append(name)
                name = ""
            elif g[0] in "}]":
                if stack:
                    stack.pop()
                name = ""
            elif g != ",":
                s, e = (t.start(1), t.end(1)) if t.group(1) is not None else t.span()
                out.append((".".join(x for x in (*stack, name) if x), s, e))
        return out
    depth: list[tuple[int, str]] = []
    section, at, block, whole = "", 0, -1, True
    body_at: list[int] = []  # of a block scalar: its start and end
    block_key, passed = "", 0
    yaml = kind in ("yaml", "yml")

    def path_of(*last: str) -> str:
        return ".".join(x for x in (section, *(n for _, n in depth), *last) if x)

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        start, at = at, at + len(line)
        body = line.rstrip()
        bare = body.lstrip()
        indent = len(body) - len(bare)
        if block >= 0:
            if bare and indent <= block:
                block = -1
                if body_at:
                    out.append((block_key, *body_at))
            else:
                if bare:
                    body_at = [body_at[0] if body_at else start + indent, start + len(body)]
                continue
        if start < passed or not bare or bare[0] in "#;!":
            continue
        if kind in ("ini", "cfg", "conf", "cnf", "toml") and bare[0] == "[":
            section = bare.strip("[]")
            continue
        sep = r"\s*:(?:\s+|$)" if kind in ("yaml", "yml") else r"\s*[=:]\s*" if kind == "properties" else r"\s*=\s*"
        m = re.match(r"(\s*(?:- +)*(?:export +)?)[\"']?((?!-\s)[^\s:=\"'\[\]{}][^:=\"']*?)[\"']?" + sep, body)
        item = ITEM.match(body) if yaml and not m else None
        if item:
            while depth and depth[-1][0] > len(item.group(1)):
                depth.pop()
            lead, name = item.end() - 1, ""
            s, e = start + item.end(), start + len(body)
            if pair := ITEM_PAIR.match(text, s + (text[s : s + 1] in "\"'"), e):
                name, s = pair.group(1), pair.end()
                e -= text[e - 1] in "\"'" and text[start + item.end()] == text[e - 1]
        elif not m:
            continue
        else:
            lead, name = len(m.group(1)), m.group(2).strip()
            s, e = start + m.end(), start + len(body)
        if yaml:
            if m:
                while depth and depth[-1][0] >= lead:
                    depth.pop()
                if m.end() == len(body):
                    depth.append((lead, name))
                    continue
            if BLOCK.fullmatch(text, s, e):
                block, block_key, body_at = lead if m else indent, path_of(name), []
                continue
            if text[s] == "[" or text[s] == "{" and text[s : s + 2] != "{{":
                inner, end = flow_values(text, s, len(text) if whole else e)
                if end < 0 and whole:  # not closed anywhere: neither are those behind it
                    whole = False
                    inner, end = flow_values(text, s, e)
                passed = max(passed, end)
                out += [(path_of(name, k) if k else path_of(name), a, b) for k, a, b in inner]
                continue
        elif c := re.search(r"\s+[#;]\s", text[s:e]) if text[s : s + 1] not in "\"'" else None:
            e = s + c.start()
        if e - s >= 2 and text[s] in "\"'":
            q = text.find(text[s], s + 1, e)
            s, e = s + 1, q if q > 0 else e
        elif yaml and (c := re.search(r"\s+#", text[s:e])):
            e = s + c.start()
        out.append((path_of(name), s, e))
    if block >= 0 and body_at:
        out.append((block_key, *body_at))
    return out


def remarks(line: str) -> list[tuple[int, int]]:
    """(start, end) of the remarks of a line of whatever length, each up to its closing mark or the end of the line.

    >>> [" /* a */ b // c"[s:e] for s, e in remarks(" /* a */ b // c")]
    ['a ', 'c']
    """
    out, at = [], 0
    mark = REMARK if len(line) < LONG else LONG_REMARK
    while m := mark.search(line, at):
        close = REMARK_END.get(m.group()[:2])
        end = line.find(close, m.end()) if close else -1
        out.append((m.end(), end if end >= 0 else len(line)))
        if end < 0:
            break
        at = end + len(close)
    return out


def _on_line(text: str, line: int, stop: int) -> list[Finding]:
    """Findings that begin on one line: literals behind names, arguments of calls, remarks."""
    found: list[Finding] = []
    for m in ASSIGNED.finditer(text, line, stop):
        name = m.group(1) or m.group(2)
        level = sensitive(name.rpartition(".")[2] or name)
        if not level:
            continue
        quote = m.group(4)
        start, end = m.end(), _closing(text, m.end(), quote)
        parts, last = [text[start:end]], end
        while len(quote) == 1 and (j := JOINED.match(text, last + 1)):
            close = _closing(text, j.end(), j.group(1))
            parts.append(text[j.end() : close])
            last = close
        value = "".join(parts)
        if quote == "`" and "${" in value or "-----BEGIN" in value:
            continue
        if level == 2 and chosen(value) or level == 1 and (strong(value) or len(parts) > 1 and chosen(value)):
            found.append(Finding(start, last, "name", name))
    for m in CALL.finditer(text, line, stop):
        strings = list(STRING.finditer(m.group(1)))
        for k, t in enumerate(strings if len(strings) >= 2 else ()):
            v = t.group(2)
            last = k == len(strings) - 1
            if last:
                good = strong(v) or chosen(v) and len(v) >= 9 and re.search(r"\d", v) and not re.search(r"[/.]", v)
            else:  # hosts, names and ids stand there as well
                named = NAMED.search(m.group(1), max(0, t.start() - 80), t.start())
                good = strong(v) and not NAMELIKE.fullmatch(v) and not (named and not sensitive(named.group(1)))
            if good and not ADDRESS.search(v):
                found.append(Finding(m.start(1) + t.start(2), m.start(1) + t.end(2), "call", ""))
    here = text[line:stop]
    for start, end in remarks(here):
        word = REMARK_WORD.search(here, start, end)
        if not word:
            continue
        for t in REMARK_VALUE.finditer(here, word.end(), end):
            if strong(t.group().rstrip(".")) and not NO_SECRET.search(here, max(start, t.start() - 64), t.start()):
                found.append(Finding(line + t.start(), line + t.end(), "remark", word.group()))
    return found


def find(text: str, path: str = "") -> list[Finding]:
    """Findings in order of their place, none inside another. A text without any is [].

    >>> [f.kind for f in find('db_pass = "aB3dE6gH9"')]
    ['name']
    """
    if not text:
        return []
    found: list[Finding] = []
    if "-----BEGIN" in text:
        for m in KEY_BLOCK.finditer(text):
            if KEY_BODY.match(text, m.end()):
                end = KEY_END.search(text, m.end())
                found.append(Finding(m.start(), end.end() if end else len(text), "private key", ""))
    if "://" in text and "@" in text:
        for m in ADDRESS.finditer(text):
            user, secret, _ = m.groups()
            if literal(secret) and not LOOKUP.search(user) and not (user.lower() in ("user", "username", "name") and re.fullmatch(r"(?i)pass\w*|pwd|secret", secret)):
                found.append(Finding(*m.span(2), "address", user))
    if "Basic " in text or "Bearer " in text or "Token " in text:
        for m in HEADER.finditer(text):
            if m.group(1) and basic_login(m.group(2)):
                found.append(Finding(*m.span(2), "encoded login", m.group(1)))
            elif m.group(3) and (m.group(4).startswith("eyJ") or strong(m.group(4))):
                found.append(Finding(*m.span(4), "header", m.group(3)))
    found += [Finding(s, e, "issued token", "") for s, e in issued(text)]
    if CONFIG.search(path):
        for key, s, e in config_values(path, text):
            name, value = key.rpartition(".")[2], text[s:e]
            level = sensitive(name) or int(name[-1:] in "sS" and sensitive(name[:-1]) == 2)  # of several, each must look like one
            if "\n" in value:
                level, value = min(level, 1), re.sub(r"\s*\n\s*", "", value)
            if level == 2 and chosen(value) or level == 1 and strong(value):
                found.append(Finding(s, e, "configuration", key))
    for line, stop in marked_lines(text):
        found += _on_line(text, line, stop)
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if not out or f.start >= out[-1].end:
            out.append(f)
        elif f.end > out[-1].end:
            out[-1] = Finding(out[-1].start, f.end, out[-1].kind, out[-1].key)
    return out


def redact(text: str, findings: list[Finding], mark: str = "[REDACTED]") -> str:
    """The text with each finding's characters replaced; line breaks within a finding stay, so no line moves."""
    out, at = [], 0
    for f in findings:
        out += [text[at : f.start], mark + "\n" * text.count("\n", f.start, f.end)]
        at = f.end
    return "".join([*out, text[at:]])


FOUND = "origin string, record_id long, file_path string, line_no long, start_byte long, end_byte long, kind string, key string"


def sources(loader_samples: DataFrame, code_chunks: DataFrame) -> DataFrame:
    """(origin, record_id, file_path, content) of all texts that may hold credentials; null texts are left out."""
    return (
        crossfile_entries(loader_samples).select(F.lit("crossfile").alias("origin"), "record_id", "file_path", "content")
        .unionByName(loader_samples.select(F.lit("left_context").alias("origin"), F.col("sample_id").alias("record_id"), F.lit("").alias("file_path"), F.col("left_context").alias("content")))
        .unionByName(code_chunks.select(F.lit("chunk").alias("origin"), F.col("chunk_key").alias("record_id"), "file_path", F.col("text").alias("content")))
        .filter(F.length("content") > 0)
    )


def find_credentials(texts: DataFrame) -> DataFrame:
    """One row for each finding in (origin, record_id, file_path, content): line (from 1) and UTF-8 byte range, kind, key.

    Rows never move: each text is read once by the task that scans it. Null or empty contents hold none; repeated rows are reported each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for origin, key, path, text in b.itertuples(index=False):
                for f in find(text, path or ""):
                    s = len(text[: f.start].encode("utf-8", "replace"))
                    rows.append((origin, key, path, text.count("\n", 0, f.start) + 1, s, s + len(text[f.start : f.end].encode("utf-8", "replace")), f.kind, f.key))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return spread(texts.select("origin", "record_id", "file_path", "content")).mapInPandas(run, FOUND)


def redact_credentials(texts: DataFrame) -> DataFrame:
    """(origin, record_id, file_path, findings, content) of the texts that hold credentials, with these blanked out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for origin, key, path, text in b.itertuples(index=False):
                if found := find(text, path or ""):
                    rows.append((origin, key, path, len(found), redact(text, found)))
            yield pd.DataFrame(rows, columns=["origin", "record_id", "file_path", "findings", "content"])

    return spread(texts.select("origin", "record_id", "file_path", "content")).mapInPandas(run, "origin string, record_id long, file_path string, findings int, content string")
