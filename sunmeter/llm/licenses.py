"""License scans: templates with markup, compiled into one automaton over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sunmeter.llm.common import map_rows

# Fixed value: what counts as a word, once A-Z are in lower case.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_WORDS = re.compile(LICENSE_WORD).findall

OTHER = None  # a word that no edge of a state names
MAX_CACHED_STATES = 20_000


@dataclass(frozen=True)
class Template:
    """A license text with markup.

    ``<<beginOptional>> ... <<endOptional>>`` may be left out, also nested;
    ``<<var;name="holder";original="the authors";words="1-20">>`` stands for any
    words in that number; all other wording is mandatory.  Case and punctuation
    don't count.
    """

    name: str
    label: str
    text: str
    base: bool = False  # a fixed phrase, rather than a license's own wording


def base_phrase(phrase: str, label: str) -> Template:
    return Template(f"base:{label}", label, phrase, base=True)


# The phrases every scan looks for, with their labels.
BASE_PHRASES = (
    base_phrase("under the mit license", "mit"),
    base_phrase("apache license version 2", "apache-2"),
    base_phrase("cc by nc", "cc-by-nc"),
)

# The wording of public licenses and of the notices that name them.
LICENSE_TEMPLATES = (
    Template("mit-notice", "mit", """
        Released under the <<beginOptional>>terms of the<<endOptional>> MIT License"""),
    Template("mit-text", "mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="software";original="this software and associated documentation files (the
        Software)";words="1-12">>, to deal in the Software without restriction, including without
        limitation <<beginOptional>>on<<endOptional>> the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";
        original="THE AUTHORS OR COPYRIGHT HOLDERS";words="1-20">> BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    Template("apache-2-notice", "apache-2", """
        Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License
        <<beginOptional>>,<<endOptional>> Version 2.0 <<beginOptional>>(the "License"); you may not
        use this file except in compliance with the License. You may obtain a copy of the License
        at <<var;name="address";original="its address";words="1-12">> Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the
        License<<endOptional>>"""),
    Template("gpl-3-notice", "gpl-3", """
        licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>(GPL)<<endOptional>> version 3"""),
    Template("gpl-3-header", "gpl-3", """
        This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version
        3 of the License, or (at your option) any later version"""),
    Template("cc-by-nc-notice", "cc-by-nc", """
        licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<beginOptional>>SA
        <<endOptional>> <<var;name="version";original="4.0";words="0-2">>"""),
    Template("cc-by-nc-deed", "cc-by-nc", """
        licensed under a Creative Commons Attribution NonCommercial
        <<beginOptional>>ShareAlike<<endOptional>> <<var;name="version";original="4.0";words="0-2">>
        International License"""),
    Template("isc-text", "isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies"""),
    Template("bsd-conditions", "bsd", """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met
        <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer"""),
)

_MARK = re.compile(r"<<(.*?)>>", re.S)
_BOUNDS = re.compile(r'words="(\d+)-(\d+)"')


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").translate(LOWER))


def parse(template: Template) -> list[tuple]:
    """The template as nested parts: ("word", w), ("var", low, high), ("optional", parts)."""
    stack: list[list[tuple]] = [[]]
    for place, piece in enumerate(_MARK.split(template.text)):
        if place % 2 == 0:
            stack[-1].extend(("word", word) for word in words_of(piece))
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional" and len(stack) > 1:
            inside = stack.pop()
            if inside:
                stack[-1].append(("optional", inside))
        elif piece.startswith("var;") and (bounds := _BOUNDS.search(piece)):
            low, high = int(bounds[1]), int(bounds[2])
            if low > high:
                raise ValueError(f"{template.name}: words={low}-{high}")
            stack[-1].append(("var", low, high))
        else:
            raise ValueError(f"{template.name}: markup {piece!r}")
    if len(stack) > 1:
        raise ValueError(f"{template.name}: an optional region is not closed")
    parts = stack[0]
    if not parts or parts[0][0] != "word" or all(part[0] != "word" for part in parts):
        raise ValueError(f"{template.name}: a template begins with a mandatory word")
    return parts


@dataclass
class Automaton:
    """All templates in one nondeterministic automaton, made deterministic as texts need it."""

    templates: Sequence[Template]
    named: list[dict[str, list[int]]] = field(default_factory=list)  # state -> word -> states
    other: list[list[int]] = field(default_factory=list)  # state -> states after any word
    free: list[list[int]] = field(default_factory=list)  # state -> states without a word
    accepts: dict[int, int] = field(default_factory=dict)  # state -> template

    def __post_init__(self) -> None:
        root = self._state()
        for number, template in enumerate(self.templates):
            end = self._chain(root, parse(template))
            self.accepts[end] = number
        self.first = self._closed({root})
        self._forget()
        self.starts = frozenset(self._edges(self.first))

    def _state(self) -> int:
        self.named.append(defaultdict(list))
        self.other.append([])
        self.free.append([])
        return len(self.named) - 1

    def _chain(self, start: int, parts: list[tuple]) -> int:
        """Append ``parts`` behind a state; the state they end in."""
        at = self._state()
        self.free[start].append(at)
        for part in parts:
            if part[0] == "word":
                after = self._state()
                self.named[at][part[1]].append(after)
            elif part[0] == "optional":
                after = self._chain(at, part[1])
                self.free[at].append(after)
            else:
                after = self._state()
                for count in range(part[2]):
                    if count >= part[1]:
                        self.free[at].append(after)
                    step = self._state()
                    self.other[at].append(step)
                    at = step
                self.free[at].append(after)
            at = after
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, done = list(states), set(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in done:
                    done.add(state)
                    todo.append(state)
        return frozenset(done)

    def _forget(self) -> None:
        self.numbers: dict[frozenset[int], int] = {}
        self.steps: list[dict[str | None, int]] = []  # next state, by word
        self.found: list[tuple[int, ...]] = []  # templates accepted in a state
        self.sets: list[frozenset[int]] = []
        self._number(self.first)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            self.found.append(tuple(sorted({
                self.accepts[state] for state in states if state in self.accepts})))
        return self.numbers[states]

    def _edges(self, states: frozenset[int]) -> set[str]:
        return {word for state in states for word in self.named[state]}

    def _fill(self, number: int) -> dict[str | None, int]:
        """All steps out of a deterministic state; -1 is the end of all hope."""
        states, steps = self.sets[number], {}
        anything = {after for state in states for after in self.other[state]}
        for word in self._edges(states):
            after = {x for state in states for x in self.named[state].get(word, ())}
            steps[word] = self._number(self._closed(after | anything))
        steps[OTHER] = self._number(self._closed(anything)) if anything else -1
        self.steps[number] = steps
        return steps

    def find(self, words: Sequence[str]) -> list[tuple[int, int, int]]:
        """(template, start, end) of every place a template's wording starts, the longest end."""
        out = []
        starts = self.starts
        for start in [i for i, word in enumerate(words) if word in starts]:
            if len(self.sets) > MAX_CACHED_STATES:
                self._forget()
            state, ends = 0, {}
            for at in range(start, len(words)):
                steps = self.steps[state] or self._fill(state)
                state = steps.get(words[at], steps[OTHER])
                if state < 0:
                    break
                for template in self.found[state]:
                    ends[template] = at + 1
            out.extend((template, start, end) for template, end in sorted(ends.items()))
        return out


def scan(
    docs: DataFrame, templates: Sequence[Template] = BASE_PHRASES + LICENSE_TEMPLATES,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``n_words`` and ``matches``, every accepted place.

    A match has the template's name and label, whether it is a base phrase, and
    its words, ``first`` to ``last``, from 0.  A text is accepted where all
    mandatory wording stands in order and nothing else but what the template
    leaves open.  Null and empty texts have no words and no matches; repeated
    rows give repeated rows; other columns are not read.  Work per place is
    bounded by the longest template, so time is linear in the text.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    ddl = (f"`{id_column}` {kind}, n_words long, matches array<struct<"
           "template:string,label:string,base:boolean,first:long,last:long>>")

    def per_task():
        automaton = Automaton(templates)
        facts = [(t.name, t.label, t.base) for t in templates]

        def of(key, value):
            words = words_of(value)
            found = automaton.find(words)
            return key, len(words), [(*facts[t], start, end - 1) for t, start, end in found]

        return of

    return map_rows(docs.select(id_column, text), per_task, ddl)
