"""XML elements in one line: ``name(...)`` an element, ``k=v`` an attribute, ``k:v`` a child with nothing but that val, ``k`` an empty child, ``"..."`` text.

Values with spaces, parentheses or quotes, and empty ones, are JSON strings. Names of a name space are ``{prefix}name``.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree as ET

# fixed values: prefixes of the name spaces that settings of workbooks use
SPACES = {
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/",
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties", "xml": "http://www.w3.org/XML/1998/namespace",
}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PREFIXES = {uri: prefix for prefix, uri in SPACES.items()}
_NAME = re.compile(r"\{[^}]*\}[\w.-]+|[\w.-]+")
_BARE = re.compile(r'[^\s()"]+')


def scalar(value: str) -> str:
    return value if _BARE.fullmatch(value) else json.dumps(value, ensure_ascii=False)


def _short(name: str) -> str:
    space, _, local = name.rpartition("}")
    space = space.removeprefix("{")
    return local if space in ("", MAIN) else f"{{{_PREFIXES.get(space, space)}}}{local}"


def _long(name: str) -> str:
    space, _, local = name.rpartition("}")
    space = space.removeprefix("{")
    return f"{{{SPACES.get(space, space)}}}{local}" if space else local


def encode_items(x: ET.Element) -> str:
    """What stands inside an element."""
    out = [f"{_short(k)}={scalar(v)}" for k, v in x.attrib.items()]
    if x.text and (x.text.strip() or not len(x)):
        out.append(json.dumps(x.text, ensure_ascii=False))
    for child in x:
        plain = not len(child) and not child.text
        if plain and not child.attrib:
            out.append(_short(child.tag))
        elif plain and list(child.attrib) == ["val"]:
            out.append(f"{_short(child.tag)}:{scalar(child.get('val'))}")
        else:
            out.append(encode(child))
    return " ".join(out)


def encode(x: ET.Element) -> str:
    return f"{_short(x.tag)}({encode_items(x)})"


def decode_items(name: str, line: str) -> ET.Element:
    """The element of a name with what a line says is inside."""
    x = ET.Element(name)
    at = _fill(x, line, 0)
    if at != len(line):
        raise ValueError(f"unbalanced parentheses in {line[:60]!r}")
    return x


def _value(line: str, at: int) -> tuple[str, int]:
    if line.startswith('"', at):
        return json.decoder.scanstring(line, at + 1)
    m = _BARE.match(line, at)
    return (m[0], m.end()) if m else ("", at)


def _fill(x: ET.Element, line: str, at: int) -> int:
    while at < len(line) and line[at] != ")":
        if line[at] == " ":
            at += 1
            continue
        if line[at] == '"':
            x.text, at = json.decoder.scanstring(line, at + 1)
            continue
        m = _NAME.match(line, at)
        if not m:
            raise ValueError(f"no name at {at} in {line[:60]!r}")
        name, at = _long(m[0]), m.end()
        mark = line[at : at + 1]
        if mark == "=":
            value, at = _value(line, at + 1)
            x.set(name, value)
        elif mark == ":":
            value, at = _value(line, at + 1)
            ET.SubElement(x, name).set("val", value)
        elif mark == "(":
            at = _fill(ET.SubElement(x, name), line, at + 1)
            if line[at : at + 1] != ")":
                raise ValueError(f"missing ) in {line[:60]!r}")
            at += 1
        else:
            ET.SubElement(x, name)
    return at


def to_xml(name: str, line: str) -> str:
    """XML text of an element, without name spaces but those of prefixes."""
    return ET.tostring(decode_items(name, line), encoding="unicode")
