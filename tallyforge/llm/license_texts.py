"""Licence templates in markup: whole licence texts, headers of source files, notices and tags.

``<<beginOptional>> ... <<endOptional>>`` may be missing; ``<<var;max=k>>`` stands for 0 to k words.  The wording is that of
the public licences; fixed values, as a licence is its wording.
"""

_COPYRIGHT = "<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=24>><<endOptional>> <<beginOptional>>All rights reserved.<<endOptional>>"
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=10>> BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""

#: Whole licence texts, by label (SPDX names).
TEXTS = {
    "MIT": f"""<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=6>> (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
{_MIT_DISCLAIMER}""",
    "MIT-0": f"""<<beginOptional>>MIT No Attribution<<endOptional>> {_COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=6>> (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so. {_MIT_DISCLAIMER}""",
    "ISC": f"""<<beginOptional>>ISC License<<endOptional>> {_COPYRIGHT} Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}""",
    "0BSD": f"""<<beginOptional>>BSD Zero Clause License<<endOptional>> {_COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted. {_ISC_DISCLAIMER}""",
    "BSD-2-Clause": f"<<beginOptional>>BSD 2-Clause License<<endOptional>> {_COPYRIGHT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"""<<beginOptional>>BSD 3-Clause License<<endOptional>> {_COPYRIGHT} {_BSD_CONDITIONS} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;max=12>> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "Zlib": f"""<<beginOptional>>zlib License<<endOptional>> {_COPYRIGHT} This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required.
<<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """<<beginOptional>>Boost Software License - Version 1.0 <<beginOptional>>- August 17th, 2003<<endOptional>><<endOptional>> Permission is hereby granted, free of charge, to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant,
this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
<<beginOptional>>For more information, please refer to <<var;max=6>><<endOptional>>""",
    "WTFPL": """<<beginOptional>>DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE <<beginOptional>>Version 2, December 2004<<endOptional>><<endOptional>> <<beginOptional>>Copyright <<var;max=16>><<endOptional>>
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
}


def _gnu(name: str, version: str, thing: str = "program") -> str:
    return f"""<<beginOptional>>This {thing}<<endOptional>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, <<beginOptional>>either<<endOptional>> version {version} of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.
<<beginOptional>>This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.<<endOptional>>
<<beginOptional>>You should have received a copy of the GNU {name} along with this {thing}<<beginOptional>>. If not, see <<var;max=6>><<endOptional>><<endOptional>>"""


#: Headers of source files and notices in prose.
NOTICES = {
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
<<beginOptional>>You may obtain a copy of the License at <<var;max=8>><<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-2.0-header": _gnu("General Public License", "2"),
    "GPL-3.0-header": _gnu("General Public License", "3"),
    "AGPL-3.0-header": _gnu("Affero General Public License", "3"),
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1", "library"),
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at <<var;max=6>>""",
    "gpl-3.0-notice": "<<beginOptional>>this <<var;max=4>> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> gnu general public license <<beginOptional>>gpl<<endOptional>> <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-2.0-notice": "<<beginOptional>>this <<var;max=4>> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> gnu general public license <<beginOptional>>gpl<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>",
    "mit-notice": "<<beginOptional>>this <<var;max=4>> is<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this <<var;max=3>> and associated documentation files",
    "cc-by-4.0-notice": "licensed under <<beginOptional>>a creative commons attribution<<endOptional>> <<beginOptional>>license<<endOptional>> cc by 4 0",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a creative commons attribution<<endOptional>> <<beginOptional>>license<<endOptional>> cc by nc 4 0",
    "cc-by-sa-4.0-notice": "licensed under <<beginOptional>>a creative commons attribution<<endOptional>> <<beginOptional>>license<<endOptional>> cc by sa 4 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc0-1.0-notice": "to the extent possible under law <<var;max=12>> waived all copyright and related or neighboring rights to <<var;max=12>> this work",
}
#: Tags of source files.
TAGS = {f"spdx:{name}": f"SPDX-License-Identifier: {name}" for name in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0")}
