"""License notices and full texts that are looked for; public texts, fixed values.

Full texts are the files of ``license_full``; notices are the usual ones of each family and version.
"""

import pkgutil

FULL_TEXTS = (
    "Apache-2.0", "Artistic-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0",
)

TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_END = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in "
    "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_MORE = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted." + _ISC_END,
    ],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_3 + _BSD_END],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["creativecommons.org/publicdomain/zero/1.0", "Creative Commons CC0 1.0 Universal"],
    "ISC": [TEMPLATES["ISC"][0] + _ISC_END],
    "MIT": [TEMPLATES["MIT"][1] + _MIT_END],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions",
    ],
}
#: Verbs before a name too short to stand alone, and names of licenses without versions.
_VERBS = ("Licensed", "Released", "Distributed", "Available", "Published")
_PLAIN = {
    "0BSD": "Zero-Clause BSD License", "BSD": "BSD License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License", "MIT": "MIT License", "Zlib": "zlib License",
}
#: Families of the Free Software Foundation, and names of others, with their versions.
_GNU = {
    "AGPL": ("GNU Affero General Public License", ("3.0",)), "GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")),
}
_NAMED = {
    "Apache": ("Apache License", ("1.1", "2.0")), "Artistic": ("Artistic License", ("1.0", "2.0")),
    "CDDL": ("Common Development and Distribution License", ("1.0", "1.1")), "EPL": ("Eclipse Public License", ("1.0", "2.0")),
    "GFDL": ("GNU Free Documentation License", ("1.1", "1.2", "1.3")), "MPL": ("Mozilla Public License", ("1.0", "1.1", "2.0")),
}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _versions():
    """``(label, notice)`` of the families with versions."""
    for family, (name, versions) in _GNU.items():
        for version in versions:
            label, short = f"{family}-{version}", version.removesuffix(".0")
            for v in {short, version}:
                yield label, f"under the terms of version {v} of the {name}"
                for form in (f"version {v}", f"v{v}", f"v {v}"):
                    yield label, f"{name} {form}"
            yield label, (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as "
                f"published by the Free Software Foundation, either version {short} of the License, or (at your option) any "
                "later version."
            )
            yield label, (
                f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} as "
                f"published by the Free Software Foundation; version {short} of the License."
            )
    yield "LGPL-2.0", (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
        "any later version."
    )
    for family, (name, versions) in _NAMED.items():
        for version in versions:
            for form in (f"version {version}", f"v{version}", f"v. {version}", version):
                yield f"{family}-{version}", f"under the {name} {form}"
                yield f"{family}-{version}", f"under the terms of the {name} {form}"
    for family, (_, versions) in (_GNU | _NAMED).items():
        for version in versions:
            yield f"{family}-{version}", f"SPDX-License-Identifier: {family}-{version}"
    for code, name in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label = f"CC-{code}-{version}"
            yield label, f"Licensed under CC {code} {version}"
            yield label, f"licensed under a Creative Commons {name} {version}"
            yield label, f"SPDX-License-Identifier: {label}"
            yield label, f"creativecommons.org/licenses/{code}/{version}"
            for form in {name, name.replace("NoDerivatives", "NoDerivs")}:
                for kind in ("International", "Unported", "Generic", "License"):
                    yield label, f"Creative Commons {form} {version} {kind}"


def _add():
    for label, name in _PLAIN.items():
        for verb in _VERBS:
            yield label, f"{verb} under the {name}"
        yield label, f"under the terms of the {name}"
    for label, texts in _MORE.items():
        yield from ((label, text) for text in texts)
    yield from sorted(_versions())
    for label in FULL_TEXTS:
        yield label, pkgutil.get_data(__package__, f"license_full/{label}.txt").decode()


#: All that is looked for: the notices above, and those and the full texts of the other families and versions.
LIBRARY = {label: list(texts) for label, texts in TEMPLATES.items()}
for _label, _text in _add():
    if _text not in LIBRARY.setdefault(_label, []):
        LIBRARY[_label].append(_text)
