"""License scans: ordered signature rules, keyword gates, priorities and interval containment.

A text becomes its words joined by single spaces, so that rules see neither punctuation nor line ends. A rule has
keywords, a regular expression over words, a label, a weight (its priority) and a place in the order. Rules are:
  * SIGNATURES: passages of license bodies, notices and headers, written one by one;
  * references: how texts name a license, grant by it, point to its address or file (TEMPLATES), for each of FAMILIES.

Gates in three steps: a text without any word of a short list is done; then a rule's own keywords must occur; the
references of a template are tried only if one expression over all its families, which Java compiles once, finds any.
Matches are intervals of words. They are resolved by falling weight, then (start, longer first, rule order): a match stays
if it overlaps none that stays. That resolves `apache license` inside `licensed under the apache license version 2 0`, and
what a suppressed match has hidden comes free with it. Base phrases are never suppressed.

DataFrame functions only, one map without a shuffle; rules are a constant of the plan.

Defined results: null and empty texts have no words, no labels and score 0; of overlapping matches of one weight the
earlier, longer, earlier-listed stays; repeated rows give a row each; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import ascii_lower, table

#: All ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, how a text names the license (words), its identifier as words, words of its address. Versions follow a name.
FAMILIES = (
    ("mit", "(?:mit|expat|mit x11|x11)", "mit", "opensource org licenses? mit"),
    ("mit-0", "mit (?:no attribution|zero|0)", "mit 0", "opensource org licenses? mit 0"),
    ("apache", "apache(?: software)?", "apache(?: \\d)*", "apache org licenses"),
    ("gpl", "(?:gnu )?(?:general public|gpl(?:v\\d)?)", "gpl(?: \\d)*", "gnu org licenses gpl(?: \\d)*"),
    ("lgpl", "(?:gnu )?(?:lesser general public|library general public|lgpl(?:v\\d)?)", "lgpl(?: \\d)*", "gnu org licenses lgpl(?: \\d)*"),
    ("agpl", "(?:gnu )?(?:affero general public|agpl(?:v\\d)?)", "agpl(?: \\d)*", "gnu org licenses agpl(?: \\d)*"),
    ("gfdl", "(?:gnu )?(?:free documentation|gfdl|fdl)", "gfdl(?: \\d)*", "gnu org licenses fdl(?: \\d)*"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause", "opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause", "spdx org licenses? bsd 4 clause"),
    ("bsd", "(?:berkeley software distribution|bsd)", "bsd", "opensource org licenses? bsd"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd", "opensource org licenses? 0bsd"),
    ("isc", "(?:isc|internet systems consortium)", "isc", "opensource org licenses? isc"),
    ("mpl", "(?:mozilla public|mpl)", "mpl(?: \\d)*", "mozilla org mpl"),
    ("epl", "(?:eclipse public|epl)", "epl(?: \\d)*", "eclipse org legal epl"),
    ("cddl", "(?:common development and distribution|cddl)", "cddl(?: \\d)*", "opensource org licenses? cddl"),
    ("cpl", "(?:common public|cpl)", "cpl(?: \\d)*", "opensource org licenses? cpl"),
    ("eupl", "(?:european union public|eupl)", "eupl(?: \\d)*", "joinup ec europa eu \\w+ eupl"),
    ("artistic", "(?:perl )?artistic", "artistic(?: \\d)*", "opensource org licenses? artistic"),
    ("zlib", "(?:zlib libpng|zlib)", "zlib", "opensource org licenses? zlib"),
    ("boost", "boost(?: software)?", "bsl 1 0", "boost org license"),
    ("unlicense", "unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl", "wtfpl net"),
    ("python", "(?:python software foundation|psf|python)", "(?:psf|python)(?: \\d)*", "python org \\w* ?license"),
    ("php", "php", "php(?: \\d)*", "php net license"),
    ("postgresql", "postgresql", "postgresql", "postgresql org about licence"),
    ("ruby", "ruby", "ruby", "ruby lang org \\w+ about license"),
    ("openssl", "openssl", "openssl", "openssl org source license"),
    ("ofl", "(?:sil open font|open font|ofl)", "ofl(?: \\d)*", "scripts sil org ofl"),
    ("ms-pl", "(?:microsoft public|ms pl)", "ms pl", "opensource org licenses? ms pl"),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", "ms rl", "opensource org licenses? ms rl"),
    ("upl", "(?:universal permissive|upl)", "upl(?: \\d)*", "oss oracle com licenses upl"),
    ("odbl", "(?:open database|odbl)", "odbl(?: \\d)*", "opendatacommons org licenses odbl"),
    ("odc-by", "(?:open data commons attribution|odc by)", "odc by(?: \\d)*", "opendatacommons org licenses by"),
    ("pddl", "(?:public domain dedication and|pddl)", "pddl(?: \\d)*", "opendatacommons org licenses pddl"),
    ("cc0", "(?:creative commons (?:zero|0)|cc0|cc zero)", "cc0(?: \\d)*", "creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv\\w*|(?:creative commons|cc) by nc nd)", "cc by nc nd(?: \\d)*", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|(?:creative commons|cc) by nc sa)", "cc by nc sa(?: \\d)*", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|(?:creative commons|cc) by nc)", "cc by nc(?: \\d)*", "creativecommons org licenses by nc"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv\\w*|(?:creative commons|cc) by nd)", "cc by nd(?: \\d)*", "creativecommons org licenses by nd"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|(?:creative commons|cc) by sa)", "cc by sa(?: \\d)*", "creativecommons org licenses by sa"),
    ("cc-by", "(?:creative commons attribution|(?:creative commons|cc) by)", "cc by(?: \\d)*", "creativecommons org licenses by"),
    ("openrail", "(?:(?:creativeml |bigscience )?open ?rail(?: m)?)", "openrail(?: m)?", "huggingface co spaces \\w+ license"),
    ("sspl", "(?:server side public|sspl)", "sspl(?: \\d)*", "mongodb com licensing server side public license"),
    ("busl", "(?:business source|busl)", "busl(?: \\d)*", "mariadb com bsl"),
    ("elastic", "elastic", "elastic(?: \\d)*", "elastic co licensing"),
    ("llama", "llama(?: \\d+)* community", "llama(?: \\d)+", "llama meta com license"),
    ("public-domain", "public domain", "public domain", "creativecommons org publicdomain mark"),
    ("proprietary", "(?:proprietary|commercial)", "proprietary", None),
)

VERSION = "(?: (?:version|v) ?\\d+(?: \\d+)*| \\d+(?: \\d+)+)?(?: (?:only|or (?:any )?later(?: version)?))?"
WORD = "licen[cs]e"

#: Kinds of signature in their order: keyword, expression with the family's parts, weight.
TEMPLATES = (
    ("spdx", ("spdx",), f"spdx {WORD} identifier {{id}}(?: only| or later)?", 1.0),
    ("address", (), "(?:https? )?(?:www )?{url}(?: \\d+(?: \\d+)*)?", 0.9),
    ("grant", ("d under", "available under", "to you under"), f"(?:re)?(?:licen[cs]ed|released|distributed|published|available|provided|covered|offered)(?: to you)? under(?: the)?(?: terms (?:of|and conditions of))?(?: the| a)? {{name}}(?: {WORD})?(?: agreement)?{VERSION}", 0.95),
    ("terms", ("terms of", "terms and"), f"(?:subject to|governed by|under)(?: the)? terms (?:of|and conditions of)(?: the| a)? {{name}}(?: {WORD})?{VERSION}", 0.85),
    ("dedication", ("dedicated to",), "dedicated to(?: the)? {name}", 0.85),
    ("file", ("licen",), f"see (?:the )?(?:file )?(?:{WORD}|copying {WORD})(?: file| txt| md)? for (?:the )?{{name}}(?: {WORD})?{VERSION}", 0.8),
    ("field", ("license",), f"license(?: is)?(?: the)? {{id}}", 0.6),
    ("title", ("licen",), f"{{name}} {WORD}(?: agreement)?{VERSION}", 0.7),
)


#: Signatures written one by one: label, weight, expression over words. Passages of license bodies weigh most, notices
#: in file headers next, clauses that several licenses share the least.
SIGNATURES = (
    ("mit", 0.98, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.9, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", 0.85, "the above copyright notice and this permission notice (?:\\w+ ){0,4}shall be included in all copies or substantial portions of the software"),
    ("mit", 0.6, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", 0.99, "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("boost", 0.99, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", 0.9, "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("isc", 0.98, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", 0.85, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", 0.985, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd-2-clause", 0.9, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 0.8, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.8, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.6, "this software is provided by (?:the )?(?:\\w+ ){1,12}as is and any express(?:ed)? or implied warranties"),
    ("bsd-3-clause", 0.95, "neither the name of (?:the )?(?:\\w+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 0.93, "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", 0.96, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", 0.97, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 0.75, "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("mit", 0.75, "use of this source code is governed by an? mit (?:style )?license"),
    ("apache", 0.97, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", 0.93, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", 0.9, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", 0.9, "the asf licenses this file to you under the apache license"),
    ("apache", 0.9, "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache", 0.88, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", 0.95, "this product includes software developed by the apache software foundation"),
    ("gpl", 0.97, "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 0.93, "you should have received a copy of the gnu general public license along with"),
    ("gpl", 0.7, "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", 0.95, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", 0.93, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", 0.93, "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("gpl", 0.9, "when we speak of free software we are referring to freedom not price"),
    ("gpl", 0.9, "this general public license does not permit incorporating your program into proprietary programs"),
    ("gpl-classpath", 0.98, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-gcc-exception", 0.98, "the gcc runtime library exception"),
    ("lgpl", 0.97, "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", 0.93, "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", 0.95, "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl", 0.93, "this license the lesser general public license applies to some specially designated software packages"),
    ("agpl", 0.97, "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", 0.93, "you should have received a copy of the gnu affero general public license along with"),
    ("agpl", 0.95, "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl", 0.93, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", 0.97, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 0.9, "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 0.93, "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("mpl", 0.97, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", 0.95, "the contents of this file are subject to the mozilla public license version"),
    ("mpl", 0.9, "this source code form is incompatible with secondary licenses"),
    ("npl", 0.95, "the contents of this file are subject to the netscape public license"),
    ("epl", 0.97, "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl", 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl", 0.95, "are made available under the terms of the eclipse distribution license"),
    ("cpl", 0.97, "the accompanying program is provided under the terms of this common public license"),
    ("ibm-public", 0.97, "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", 0.97, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 0.9, "when distributing covered code include this cddl header in each file"),
    ("eupl", 0.97, "this european union public licence (?:the )?eupl applies to the work"),
    ("eupl", 0.93, "licensed under the eupl version \\d \\d(?: or as soon they will be approved by the european commission)?"),
    ("osl", 0.95, "licensed under the open software license version"),
    ("afl", 0.95, "licensed under the academic free license version"),
    ("artistic", 0.97, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 0.97, "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic", 0.9, "you may distribute (?:it|this \\w+) under the same terms as perl itself"),
    ("artistic", 0.9, "can redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("zlib", 0.97, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 0.95, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.93, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 0.95, "this code is released under the libpng license"),
    ("curl", 0.95, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("x11", 0.95, "except as contained in this notice the name of (?:the )?(?:\\w+ ){1,6}shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("ncsa", 0.95, "to deal with the software without restriction including without limitation the rights to use"),
    ("unlicense", 0.97, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.93, "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", 0.97, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", 0.95, "to the extent possible under law (?:the )?(?:\\w+ ){1,8}(?:has|have) (?:dedicated|waived) all copyright and related"),
    ("cc0", 0.9, "statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights"),
    ("public-domain", 0.85, "(?:has been|is hereby|is|was) (?:placed|released|put) (?:in|into) the public domain"),
    ("public-domain", 0.85, "this file is in the public domain"),
    ("public-domain", 0.8, "no copyright is claimed in the united states"),
    ("wtfpl", 0.97, "you just do what the fuck you want to"),
    ("beerware", 0.97, "as long as you retain this notice you can do whatever you want with this stuff if we meet some day"),
    ("json", 0.97, "the software shall be used for good not evil"),
    ("php", 0.97, "this product includes php software freely available from"),
    ("php", 0.93, "this source file is subject to version \\d(?: \\d+)* of the php license"),
    ("openssl", 0.97, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0.97, "this product includes cryptographic software written by eric young"),
    ("python", 0.97, "psf is making python available to licensee on an as is basis"),
    ("python", 0.95, "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("postgresql", 0.93, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ruby", 0.93, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("vim", 0.95, "there are no restrictions on distributing unmodified copies of vim"),
    ("ofl", 0.97, "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("ofl", 0.95, "this font software is licensed under the sil open font license"),
    ("ms-pl", 0.95, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", 0.96, "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file"),
    ("upl", 0.97, "the universal permissive license upl"),
    ("odbl", 0.97, "this (?:\\w+ )+is made available under the open database license"),
    ("odc-by", 0.97, "is made available under the open data commons attribution license"),
    ("pddl", 0.97, "is made available under the public domain dedication and license"),
    ("cc-by", 0.9, "you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material for any purpose"),
    ("cc-by-sa", 0.93, "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", 0.93, "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", 0.93, "you may not use the material for commercial purposes"),
    ("cc-by", 0.85, "this work is licensed under a creative commons attribution \\d \\d (?:international|unported|generic) license"),
    ("cc-by-sa", 0.9, "this work is licensed under a creative commons attribution share ?alike \\d \\d"),
    ("cc-by-nc", 0.9, "this work is licensed under a creative commons attribution non ?commercial \\d \\d"),
    ("cc-by-nc-sa", 0.92, "this work is licensed under a creative commons attribution non ?commercial share ?alike \\d \\d"),
    ("cc-by-nc-nd", 0.92, "this work is licensed under a creative commons attribution non ?commercial no ?deriv\\w* \\d \\d"),
    ("openrail", 0.93, "you agree not to use the model or derivatives of the model in any way that violates any applicable national"),
    ("llama", 0.95, "llama (?:\\d+ )*is licensed under the llama (?:\\d+ )*community license"),
    ("gemma", 0.95, "gemma is provided under and subject to the gemma terms of use"),
    ("sspl", 0.95, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", 0.95, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", 0.95, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 0.95, "without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("proprietary", 0.9, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 0.85, "this (?:software|document|file|code) is (?:the )?confidential and proprietary"),
    ("proprietary", 0.85, "this (?:software|document|file|code) is (?:the )?proprietary and confidential"),
    ("proprietary", 0.85, "proprietary and confidential all rights reserved"),
    ("proprietary", 0.85, "may not be reproduced distributed or transmitted in any form or by any means without the prior written permission"),
    ("proprietary", 0.8, "no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", 0.8, "for (?:personal|internal) use only (?:redistribution|copying) is (?:strictly )?prohibited"),
)

#: Words that many keywords hold: a text is asked for these instead of for each such keyword.
COARSE = ("licen", "permission", "redistribut", "warrant", "public domain", "free software", "d under", "prohibited", "proprietary", "advertis", "the software", "this software")


def literal(pattern: str) -> str:
    """The longest run of plain characters outside groups: every match holds it."""
    runs, depth = [""], 0
    for c in pattern:
        if c == "?" and depth == 0 and runs[-1]:
            runs[-1] = runs[-1][:-1]  # the character before may be missing
        depth += (c in "([") - (c in ")]")
        if depth == 0 and (c.isalnum() or c == " "):
            runs[-1] += c
        elif runs[-1]:
            runs.append("")
        if c == "\\":
            depth += 1000  # the next character names a class
        elif depth >= 1000:
            depth -= 1000
    return max(runs, key=len).strip()


def rules() -> list[dict]:
    """Ordered signature rules: the base phrases, the signatures, then every template of every family."""
    out = [{"keywords": ["license"], "pattern": phrase, "label": label, "weight": 0.7, "base": True, "kind": 0} for phrase, label in BASE]
    for label, weight, pattern in SIGNATURES:
        out.append({"keywords": [literal(pattern)], "pattern": pattern, "label": label, "weight": weight, "base": False, "kind": 0})
    for kind, (_, keywords, body, weight) in enumerate(TEMPLATES, 1):
        for label, name, identifier, url in FAMILIES:
            if "{url}" in body and not url:
                continue
            pattern = body.replace("{name}", name).replace("{id}", identifier).replace("{url}", url or "")
            # an address is gated by its first two words unless a word for license is in it
            own = ["licen"] if "licen" in (url or "") else [" ".join((url or "").split()[:2])]
            out.append({"keywords": list(keywords) or own, "pattern": pattern, "label": label, "weight": weight, "base": False, "kind": kind})
    for i, rule in enumerate(out):
        rule |= {"rule": i, "pattern": whole_words(rule["pattern"])}
    return out


def whole_words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


RULE = "array<struct<rule:int,keywords:array<string>,pattern:string,label:string,weight:double,base:boolean,kind:int>>"
MARK = "\x01"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions inside lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), 0)


def words_joined(text: Column) -> Column:
    """The words of the text joined by single spaces, in the case that they have."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, " "))


def count_words(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def matches(norm: Column, rule: Column) -> Column:
    """Intervals (start, behind the end) of words that a rule matches, leftmost and non-overlapping."""

    def interval(start: Column, phrase: Column) -> Column:
        end = start + F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1
        # the order of fields is the order of suppression: start, longer first, rule
        return F.struct(start.alias("start"), (-end).alias("minus_end"), rule.rule.alias("rule"), end.alias("end"), rule.label.alias("label"), rule.weight.alias("weight"), rule.base.alias("base"))

    def placed(found: Column) -> Column:
        marked = F.split(F.regexp_replace(norm, rule.pattern, F.lit(MARK + "$0")), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
        return F.zip_with(starts, found, interval)

    return let(F.regexp_extract_all(norm, rule.pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(INTERVALS)))


INTERVALS = "array<struct<start:int,minus_end:int,rule:int,end:int,label:string,weight:double,base:boolean>>"


def resolve(found: Column) -> Column:
    """The matches that stay: by falling weight (then the order of fields) each that overlaps none that stays."""
    first = F.sort_array(F.transform(found, lambda m: F.struct((-m.weight).alias("minus"), m.alias("m"))))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: (k.start < x.m.end) & (x.m.start < k.end))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x.m)))

    return F.sort_array(F.aggregate(first, F.array().cast(INTERVALS), step))


def scan(docs: DataFrame, ordered: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, found (all matches) and kept (matches after suppression) of every text."""
    ordered = ordered or rules()
    constant = F.from_json(F.lit(json.dumps(ordered)), RULE)
    gates = set(COARSE) | {w for r in ordered for w in r["keywords"]}
    gate = F.lit(False)
    for word in sorted(w for w in gates if not any(v != w and v in w for v in gates)):
        gate = gate | F.contains("lowered", F.lit(word))
    rows = docs.select("doc_id", words_joined(F.col("text")).alias("joined"))
    # lower() also maps some other letters to A-Z's: it may only let too many texts pass, ascii_lower then decides
    rows = rows.select("doc_id", "joined", count_words(F.col("joined")).alias("n_words"), F.lower("joined").alias("lowered"))
    rows = rows.select("doc_id", "n_words", F.when(gate, ascii_lower(F.col("joined"))).alias("norm"))
    norm = F.col("norm")
    kinds = [F.lit(True)]
    for kind in range(1, max(r["kind"] for r in ordered) + 1):
        own = [r for r in ordered if r["kind"] == kind]
        words = {w for r in own for w in r["keywords"]}
        keyed = reduce(lambda c, w: c | F.contains(norm, F.lit(w)), sorted(words), F.lit(False))
        kinds.append(F.when(keyed, norm.rlike("|".join(r["pattern"] for r in own))).otherwise(False))
    tried = let(F.array(*kinds), lambda k: F.filter(constant, lambda r: F.get(k, r["kind"]) & F.exists(r.keywords, lambda w: F.contains(norm, w))))
    found = F.when(norm.isNotNull(), F.flatten(F.transform(tried, lambda r: matches(norm, r))))
    rows = rows.select("doc_id", "n_words", F.coalesce(found, F.array().cast(INTERVALS)).alias("found"))
    return rows.withColumn("kept", F.when(F.size("found") > 0, resolve(F.col("found"))).otherwise(F.col("found")))


def joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda m: m.base)
    starts = F.transform(base, lambda m: m.start.cast("long"))
    both = F.concat(F.transform(base, lambda m: m.label), F.transform("kept", lambda m: m.label))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda m: m.label)).alias("base_labels"),
        joined(both).alias("labels"),
        F.aggregate("kept", F.lit(0.0), lambda a, m: F.greatest(a, m.weight)).alias("score"),
    )
