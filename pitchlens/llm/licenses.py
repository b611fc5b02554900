"""Known licence sentences and the ordered rules over them.

Fixed values: the sentences are the licences' own words.  A sentence is written
as it stands in the licence and normalised by the same function as the texts.
"""

from __future__ import annotations

import re

#: identifier: its sentences.
SENTENCES: dict[str, list[str]] = {
    "RIGHTS": ["All rights reserved."],
    "APACHE2_SHORT": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "This project is licensed under the Apache License, Version 2.0."],
    "APACHE2_NOTICE": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "APACHE2_NOTICE_A": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "APACHE2_NOTICE_B": ["you may not use this file except in compliance with the License."],
    "APACHE2_COPY": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "APACHE2_ASIS": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "APACHE2_SEE": ["See the License for the specific language governing permissions and limitations under the License."],
    "MIT_SHORT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"],
    "MIT_GRANT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MIT_KEEP": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MIT_ASIS": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "MIT_LIABLE": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ISC_SHORT": ["Licensed under the ISC License."],
    "ISC_GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD_SHORT": ["Licensed under the BSD License.", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD_GRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD_SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD_BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD_ENDORSE": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL2_SHORT": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL3_SHORT": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "GPL_FREE": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL2_FREE": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL_HOPE": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GPL_SEE": ["See the GNU General Public License for more details."],
    "LGPL3_SHORT": ["Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL3_SHORT": ["Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL2_SHORT": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "MPL2_COPY": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL2_SHORT": ["Licensed under the Eclipse Public License 2.0."],
    "BSL1_SHORT": ["Distributed under the Boost Software License, Version 1.0."],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain."],
    "CC0_SHORT": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC_BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC_BY_SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC_BY_NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC_BY_ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC_BY_NC_SA": ["Licensed under CC BY-NC-SA 4.0."],
    "CC_BY_NC_ND": ["Licensed under CC BY-NC-ND 4.0."],
}

#: Licence and the identifiers, one after the other, that mean it; earlier rules take their sentences first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["APACHE2_NOTICE", "APACHE2_COPY", "APACHE2_ASIS", "APACHE2_SEE"]),
    ("Apache-2.0", ["APACHE2_NOTICE_A", "APACHE2_NOTICE_B", "APACHE2_COPY", "APACHE2_ASIS", "APACHE2_SEE"]),
    ("MIT", ["MIT_GRANT", "MIT_KEEP", "MIT_ASIS", "MIT_LIABLE"]),
    ("MIT", ["MIT_GRANT", "MIT_KEEP"]),
    ("ISC", ["ISC_GRANT"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL_HOPE", "GPL_SEE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL_HOPE", "GPL_SEE"]),
    ("GPL-3.0-or-later", ["GPL_FREE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE"]),
    ("MPL-2.0", ["MPL2_SHORT", "MPL2_COPY"]),
    ("MPL-2.0", ["MPL2_SHORT"]),
    ("Apache-2.0", ["APACHE2_SHORT"]),
    ("Apache-2.0", ["APACHE2_NOTICE"]),
    ("Apache-2.0", ["APACHE2_NOTICE_A"]),
    ("MIT", ["MIT_SHORT"]),
    ("ISC", ["ISC_SHORT"]),
    ("BSD", ["BSD_SHORT"]),
    ("GPL-2.0-only", ["GPL2_SHORT"]),
    ("GPL-3.0-only", ["GPL3_SHORT"]),
    ("LGPL-3.0-only", ["LGPL3_SHORT"]),
    ("AGPL-3.0-only", ["AGPL3_SHORT"]),
    ("EPL-2.0", ["EPL2_SHORT"]),
    ("BSL-1.0", ["BSL1_SHORT"]),
    ("Unlicense", ["UNLICENSE"]),
    ("CC0-1.0", ["CC0_SHORT"]),
    ("CC-BY-4.0", ["CC_BY"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC"]),
    ("CC-BY-ND-4.0", ["CC_BY_ND"]),
    ("CC-BY-NC-SA-4.0", ["CC_BY_NC_SA"]),
    ("CC-BY-NC-ND-4.0", ["CC_BY_NC_ND"]),
    ("proprietary", ["RIGHTS"]),
]


def normal(sentence: str) -> str:
    """A-Z lower-cased; every stretch of anything but ASCII letters and digits is one space, none at the ends."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def dictionary() -> dict[str, str]:
    return {normal(s): name for name, some in SENTENCES.items() for s in some}
