"""Public license texts, standard headers and one-line notices, as templates. Whole long texts lie in ``license_data``."""

from importlib import resources

# Wordings published with the licenses, without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""


def _gnu(what: str, name: str, version: str) -> str:
    return _GNU.format(what=what, name=name, version=version)


# Names under which licenses are spoken of, beside their identifiers.
_NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3", "GNU GPLv3 License"),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2", "GNU GPLv2 License"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "BSD-2-Clause": ("2-clause BSD License", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("3-clause BSD License", "BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Unlicense": ("The Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License",),
}
# How texts say that they are under a license.
_SAID_OF_NAMES = (
    "{}.", "Licensed under the {}.", "This project is licensed under the {}.", "This project is licensed under the {}. See the LICENSE file for details.",
    "This software is licensed under the {}.", "This work is licensed under the {}.", "Distributed under the {}.", "Distributed under the {}, see LICENSE.", "Released under the {}.",
    "This file is licensed under the {}.", "The code is available under the {}.", "License: {}",
)
_SAID_OF_IDS = ("SPDX-License-Identifier: {}", "SPDX-License-Identifier: {}-only", "SPDX-License-Identifier: {}-or-later", "License: {}", "Licensed under {}.", "This project is licensed under {}.")


def statements() -> dict[str, tuple[str, ...]]:
    """License name: the sentences that say a text is under it."""
    return {name: tuple(dict.fromkeys([p.format(n) for n in names for p in _SAID_OF_NAMES] + [p.format(name) for p in _SAID_OF_IDS])) for name, names in _NAMES.items()}


def whole_texts() -> dict[str, str]:
    """License name: its published text, of the licenses that have a file here."""
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    return {name: (resources.files("ruleweave.llm") / "license_data" / f"{file}.txt").read_text(encoding="utf-8") for name, file in files.items()}


#: License name: its texts, headers and notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", _MIT.split("\n")[0], _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _gnu("program", "GNU General Public License", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _gnu("program", "GNU General Public License", "2")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("library", "GNU Lesser General Public License", "3")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _gnu("program", "GNU Affero General Public License", "3")),
    "MPL-2.0": ("This work is subject to the terms of the Mozilla Public License, version 2.0.", _MPL),
    "EPL-2.0": (_EPL,),
    "BSD-2-Clause": ("Released under the 2-clause BSD License.", f"{_BSD_TWO}\n{_BSD_WARRANTY}"),
    "BSD-3-Clause": ("Released under the 3-clause BSD License.", f"{_BSD_TWO}\n{_BSD_NAMES}\n{_BSD_WARRANTY}"),
    "ISC": (_ISC,),
    "Zlib": (_ZLIB,),
    "BSL-1.0": (_BOOST,),
    "Unlicense": (_UNLICENSE,),
    "CC0-1.0": ("Released under CC0 1.0.", _CC0),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
}
