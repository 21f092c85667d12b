"""Texts and notices of licences as they are published, in paragraphs, with a made-up holder."""

ASIS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
BSD_END = "THIS SOFTWARE IS PROVIDED BY JANE DOE AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL JANE DOE OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'


def gnu(name, end):
    return [f"This program is free software{end.format(name=name)}", f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.", f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."]


LATER2 = "; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
LATER21 = LATER2.replace("version 2 ", "version 2.1 ")
LATER3 = ": you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
ONLY2 = "; you can redistribute it and/or modify it under the terms of the {name} version 2 as published by the Free Software Foundation."
ONLY3 = ": you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, version 3."
GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

TEXTS = {
    "MIT": ["MIT License", "Copyright (c) 2020 Jane Doe", f"{GRANT}, subject to the following conditions:", NOTICE, ASIS],
    "X11": [f"{GRANT}, subject to the following conditions:", NOTICE, ASIS, "Except as contained in this notice, the name of Jane Doe shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from Jane Doe."],
    "MIT-0": [f"{GRANT}.", ASIS],
    "BSD-2-Clause": [*BSD, BSD_END],
    "BSD-3-Clause": [*BSD, "3. Neither the name of Doe Works, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD_END],
    "BSD-4-Clause": [*BSD, "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Jane Doe.", "4. Neither the name of Jane Doe nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD_END],
    "ISC": ["ISC License", f"{ISC}, provided that the above copyright notice and this permission notice appear in all copies.", ISC_END],
    "0BSD": [f"{ISC}.", ISC_END],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-2.0-or-later": gnu(GPL, LATER2),
    "GPL-2.0-only": gnu(GPL, ONLY2),
    "GPL-3.0-or-later": gnu(GPL, LATER3),
    "GPL-3.0-only": gnu(GPL, ONLY3),
    "LGPL-2.1-or-later": gnu(LGPL, LATER21),
    "LGPL-3.0-or-later": gnu(LGPL, LATER3),
    "AGPL-3.0-or-later": gnu(AGPL, LATER3),
    "AGPL-3.0-only": gnu(AGPL, ONLY3),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "3. This notice may not be removed or altered from any source distribution."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
}
