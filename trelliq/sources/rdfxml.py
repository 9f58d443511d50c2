"""RDF/XML ontologies: node and property elements, typed nodes, references, literals and nested nodes."""

from __future__ import annotations

import xml.etree.ElementTree as ET

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"


def is_rdfxml(text: str) -> bool:
    """Whether an ontology's text is XML; Turtle never starts with an element."""
    head = text.lstrip("\ufeff \t\r\n")
    return head.startswith(("<?xml", "<!--", "<!DOCTYPE", "<rdf:RDF", "<RDF"))


def _uri(tag: str) -> str:
    space, _, name = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return space + name


def parse_rdfxml(text: str) -> list[tuple[str, str, str, bool]]:
    """(s, p, o, is_literal) of a document. An ontology is small, so it is read on the driver. Collections become their members."""
    root = ET.fromstring(text)
    base = root.get(f"{{{XML}}}base", "")
    out: list[tuple[str, str, str, bool]] = []
    blanks = iter(range(1 << 62))

    def full(ref: str) -> str:
        return ref if ":" in ref.split("/", 1)[0] or ref.startswith("_:") else base.rstrip("#") + (ref if ref.startswith("#") else "#" + ref if ref else "")

    def node(el: ET.Element) -> str:
        about, name, blank = (el.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        s = full(about) if about is not None else full("#" + name) if name else f"_:{blank or f'b{next(blanks)}'}"
        if el.tag != f"{{{RDF}}}Description":
            out.append((s, RDF + "type", _uri(el.tag), False))
        for key, value in el.attrib.items():
            if not key.startswith((f"{{{RDF}}}", f"{{{XML}}}")):
                out.append((s, _uri(key), value, True))
        for p in el:
            prop(s, p)
        return s

    def prop(s: str, el: ET.Element) -> None:
        p, ref, blank, how = _uri(el.tag), el.get(f"{{{RDF}}}resource"), el.get(f"{{{RDF}}}nodeID"), el.get(f"{{{RDF}}}parseType")
        if ref is not None or blank:
            out.append((s, p, full(ref) if ref is not None else f"_:{blank}", False))
        elif how == "Resource":
            inner = f"_:b{next(blanks)}"
            out.append((s, p, inner, False))
            for sub in el:
                prop(inner, sub)
        elif len(el):
            for child in el:
                out.append((s, p, node(child), False))
        else:
            out.append((s, p, el.text or "", True))

    for el in root if root.tag == f"{{{RDF}}}RDF" else [root]:
        node(el)
    return out
