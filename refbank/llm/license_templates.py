"""Templates of the licence scan: full texts (``license_texts``, one file per
licence), standard notices, titles and SPDX lines of the usual licences.

The full texts are the ones Debian and the Boost licence's users ship;
AGPL-3.0 is the text of GPL-3.0 with the Affero preamble and section 13 and
without the appendix.  Creative Commons deeds and legal codes are recognised by
notice, title and address (only CC0 has its full text here).
"""

from __future__ import annotations

import pkgutil

FULL_TEXTS = ("AGPL-3.0", "Apache-2.0", "Artistic-1.0-Perl", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0",
              "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")
_BSD_1 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. ")
_BSD_AD = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization. 4. Neither the name of the organization nor the names of "
    "its contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission. ")
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")

# Usual licence notices, and the text of the short licences.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        _APACHE,
        _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
        "License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [_BSD_1 + _BSD_END, _BSD_1],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_1 + _BSD_3 + _BSD_END, _BSD_1 + _BSD_3],
    "BSD-4-Clause": [_BSD_1 + _BSD_AD + _BSD_END, _BSD_1 + _BSD_AD],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work.", "Licensed under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication",
                "creativecommons.org/publicdomain/zero/1.0"],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the "
                "Eclipse Public License v1.0 which accompanies this distribution"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": [_ISC, _ISC + " " + _ISC_END],
    "MIT": ["Released under the MIT License.", _MIT, _MIT + " " + _WARRANTY],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
}

#: licence -> names it goes by in one-line notices
_NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-1.0-Perl": ["Artistic License 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-clause BSD license"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal License"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "Zlib": ["zlib License"],
}


def _gnu() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for short, full, versions in (("GPL", "GNU General Public License", ("1", "2", "3")),
                                  ("LGPL", "GNU Library General Public License", ("2",)),
                                  ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
                                  ("AGPL", "GNU Affero General Public License", ("3",))):
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            texts = [f"This work is licensed under the {full}, version {v}."]
            for what in ("program", "library") if short == "LGPL" else ("program",):
                head = (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {full} "
                        "as published by the Free Software Foundation, ")
                texts += [head + f"either version {v} of the License, or (at your option) any later version.",
                          head + f"version {v} of the License.", head + f"version {v}."]
            for called in (f"{full}, version {v}", f"{full} v{v}", f"{short} version {v}", f"{short} v{v}"):
                texts += _one_line(called)
            texts += [f"{full} as published by the Free Software Foundation; either version {v} of the License"]
            out[name] = texts + [f"SPDX-License-Identifier: {name}{x}" for x in ("", "-only", "-or-later", "+")]
    return out


def _one_line(called: str) -> list[str]:
    return [f"Licensed under the {called}", f"Released under the {called}", f"Distributed under the {called}",
            f"Available under the {called}", f"under the terms of the {called}"]


def _creative_commons() -> dict[str, list[str]]:
    words = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    out: dict[str, list[str]] = {}
    for parts in ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
        for v, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            code = "-".join(("BY", *(p.upper() for p in parts)))
            spelt = {"-".join(("Attribution", *(words[p] for p in parts))), "-".join(
                ("Attribution", *(words[p].replace("NonCommercial", "Non-Commercial").replace(
                    "ShareAlike", "Share-Alike").replace("NoDerivatives", "NoDerivs") for p in parts)))}
            texts = [f"Licensed under CC {code} {v}.", f"CC {code} {v}", f"creativecommons.org/licenses/{code.lower()}/{v}"]
            for s in sorted(spelt):
                full = f"Creative Commons {s} {v}"
                texts += [f"This work is licensed under a {full} {port} License.", f"Licensed under the {full} {port} License",
                          f"Licensed under a {full} License", f"{full} {port} Public License", f"{full} {port}", full]
            out[f"CC-{code}-{v}"] = [*texts, f"SPDX-License-Identifier: CC-{code}-{v}"]
    return out


def templates() -> dict[str, list[str]]:
    """licence -> its templates; the order of the first ones is kept."""
    out: dict[str, list[str]] = {k: list(v) for k, v in NOTICES.items()}
    for part in (_gnu(), _creative_commons(), {k: [t for x in v for t in _one_line(x)] for k, v in _NAMES.items()},
                 {k: [f"SPDX-License-Identifier: {k}"] for k in {**NOTICES, **_NAMES}},
                 {k: [pkgutil.get_data(__package__, f"license_texts/{k}.txt").decode("utf-8")] for k in FULL_TEXTS}):
        for name, texts in part.items():
            out[name] = list(dict.fromkeys([*out.get(name, []), *texts]))
    return dict(sorted(out.items()))
