"""Public license wording with markup, read by ``licenses``.

``[[...]]`` may be missing and may be nested, ``{{n}}`` stands for up to ``n`` words
of any kind. Everything else is mandatory, word for word; case and punctuation
don't count.
"""

from __future__ import annotations

#: Phrases of the base scan (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening and disclaimer that the BSD licenses share (fixed values).
BSD_OPENING = """Redistribution and use [[of this software]] in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: [[1]] [[a]] Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. [[2]] [[b]] Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
BSD_NAMES = """Neither the name of {{8}} nor the names of [[its]] [[the]] [[other]] contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {{8}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{8}} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: The grant of the MIT licenses, and their disclaimer (fixed values).
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this {{3}} and associated documentation
files (the "{{2}}"), to deal in the {{2}} without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the {{2}}, and to permit persons to whom the {{2}} is furnished to do so"""
MIT_DISCLAIMER = """THE {{2}} IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND [[NONINFRINGEMENT]] [[NON-INFRINGEMENT]]. IN NO EVENT SHALL
{{8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE {{2}} OR THE USE OR OTHER DEALINGS IN THE {{2}}."""

#: Disclaimer of the ISC licenses (fixed value).
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} [[DISCLAIM]] [[DISCLAIMS]] ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Whole licenses (fixed values).
WHOLE = {
    "mit": f"""{MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice [[(including
        the next paragraph)]] shall be included in all copies or substantial portions of the {{{{2}}}}. {MIT_DISCLAIMER}""",
    "mit-0": f"{MIT_GRANT}. {MIT_DISCLAIMER}",
    "isc": f"""Permission to use, copy, modify, [[and/or]] [[and]] distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {ISC_DISCLAIMER}""",
    "0bsd": f"""Permission to use, copy, modify, [[and/or]] [[and]] distribute this software for any purpose with or without fee is
        hereby granted. {ISC_DISCLAIMER}""",
    "bsd-2": f"{BSD_OPENING} {BSD_DISCLAIMER}",
    "bsd-3": f"{BSD_OPENING} [[3]] [[4]] [[c]] {BSD_NAMES} {BSD_DISCLAIMER}",
    "bsd-4": f"""{BSD_OPENING} [[3]] [[c]] All advertising materials mentioning features or use of this software must display the
        following [[acknowledgement]] [[acknowledgment]]: This product includes software developed by {{{{12}}}} [[4]] [[d]] {BSD_NAMES}
        {BSD_DISCLAIMER}""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the [[author]] [[authors]]
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: [[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. [[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. [[3]] This notice may not be removed or altered from any source distribution.""",
    "bsl-1": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
        the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
        whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
        software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
        of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "wtfpl": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
        allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING,
        DISTRIBUTION AND MODIFICATION [[0]] You just DO WHAT THE FUCK YOU WANT TO.""",
}

#: Middle of the notices of the GNU licenses (fixed values).
GNU = "{name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
GNU_ONLY = "{name} as published by the Free Software Foundation; version {version} [[of the License]]"
#: Name and version of each GNU license (fixed values).
GNU_LICENSES = {
    "gpl-2": ("GNU General Public License", "2"),
    "gpl-3": ("GNU General Public License", "3"),
    "lgpl-2.1": ("GNU Lesser General Public License", "2.1"),
    "lgpl-3": ("GNU Lesser General Public License", "3"),
    "agpl-3": ("GNU Affero General Public License", "3"),
}

#: Notices that stand for a whole license (fixed values).
NOTICES = {
    "apache-2": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {{3}} except in compliance with the
        License. You may obtain a copy of the License at [[http]] [[https]] www.apache.org/licenses/LICENSE-2.0 [[html]] [[txt]] Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License""",
    ),
    "mpl-2": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at [[http]] [[https]] [[www]] mozilla.org/MPL/2.0""",
    ),
    "epl-2": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License [[v]] 2.0 which
        [[accompanies this distribution and]] is available at [[http]] [[https]] www.eclipse.org/legal/epl-2.0""",
    ),
    "cc0": (
        "To the extent possible under law, {{8}} [[has]] [[have]] waived all copyright and related or neighboring rights to {{8}}",
        "[[dedicated]] [[released]] to the public domain under [[the]] [[creative commons]] cc0",
    ),
}

#: How a short notice grants (fixed values), and the names it may give to a license (fixed values).
GRANTS = ("licensed under", "released under", "distributed under", "available under", "provided under", "published under")
NAMES = {
    "mit": ("mit license",),
    "apache-2": ("apache license [[version]] 2 [[0]]", "apache 2 [[0]] license"),
    "isc": ("isc license",),
    "bsd-2": ("bsd 2 clause [[license]]", "2 clause bsd license", "simplified bsd license"),
    "bsd-3": ("bsd 3 clause [[license]]", "3 clause bsd license", "new bsd license"),
    "mpl-2": ("mozilla public license [[version]] [[v]] 2 [[0]]",),
    "gpl-2": ("gnu general public license [[as published by the free software foundation]] [[either]] version 2",),
    "gpl-3": ("gnu general public license [[as published by the free software foundation]] [[either]] version 3",),
    "lgpl-2.1": ("gnu lesser general public license version 2 1",),
    "lgpl-3": ("gnu lesser general public license version 3",),
    "agpl-3": ("gnu affero general public license version 3",),
    "cc-by": ("cc by", "creative commons attribution [[{{2}} international]] license"),
    "cc-by-sa": ("cc by sa", "creative commons attribution share alike [[{{2}} international]] license", "creative commons attribution sharealike [[{{2}} international]] license"),
    "cc-by-nd": ("cc by nd",),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial [[{{2}} international]] license", "creative commons attribution non commercial [[{{2}} international]] license"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike [[{{2}} international]] license"),
    "cc-by-nc-nd": ("cc by nc nd",),
    "cc0": ("creative commons cc0", "creative commons zero"),
}


def templates() -> dict[str, tuple[str, ...]]:
    """Whole licenses, notices, and short notices made of grants and names."""
    out: dict[str, list[str]] = {k: [v] for k, v in WHOLE.items()}
    for label, texts in NOTICES.items():
        out.setdefault(label, []).extend(texts)
    for label, (name, version) in GNU_LICENSES.items():
        out.setdefault(label, []).extend(t.format(name=name, version=version) for t in (GNU, GNU_ONLY))
    for label, names in NAMES.items():
        out.setdefault(label, []).extend(f"{g} [[a]] [[the]] [[terms of the]] {n}" for g in GRANTS for n in names)
    return {k: tuple(v) for k, v in out.items()}
