"""Licence notices and texts as template markup (fixed values: public licence wording).

``[[`` … ``]]`` is an optional region, ``{{n}}`` a replaceable region of up to n words, ``{{*}}`` one of any
number of words. Everything else is mandatory wording; only its words count, not case or punctuation.
"""

BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {{*}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{*}} BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 [[(the \"License\")]]",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at [[http]] [[https]]://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl-3.0": [
        "[[This work]] [[This program]] [[This software]] is licensed under the [[terms of the]] GNU General Public License, version 3 [[or later]]",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "gpl-2.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ],
    "mit-notice": ["[[Released]] [[Licensed]] [[Distributed]] under the [[terms of the]] MIT License"],
    "mit-text": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all
        copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{*}} BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND {{*}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{*}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "bsd-2-clause": [BSD_CLAUSES + BSD_DISCLAIMER],
    "bsd-3-clause": [
        BSD_CLAUSES
        + """ [[3.]] Neither the name of {{*}} nor the names of [[its]] [[the]] contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. """
        + BSD_DISCLAIMER,
    ],
    "lgpl-2.1": [
        """This [[library]] [[program]] is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ],
    "lgpl-3.0": [
        """This [[library]] [[program]] is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "agpl-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "gpl-2.0-only": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License version 2 only [[as published by the Free Software Foundation]]""",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License version 2 as published by the Free Software Foundation. This program is distributed in the hope that it will be useful""",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; version 2 of the License [[only]]. This program is distributed in the hope that it will be useful""",
    ],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at [[http]] [[https]]://[[www]] mozilla.org/MPL/2.0/.""",
    ],
    "cc0-1.0": ["To the extent possible under law, {{*}} [[has]] [[have]] waived all copyright and related or neighboring rights to"],
    "unlicense": [
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
        detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{*}} BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "cc-by-nc-4.0": ["Licensed under [[a]] [[the]] CC BY-NC 4.0 [[International]] [[license]]", "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-4.0": ["Licensed under [[a]] [[the]] CC BY 4.0 [[International]] [[license]]", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under [[a]] [[the]] CC BY-SA 4.0 [[International]] [[license]]", "Licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
}

# Base phrases and labels, as the contract of the query gives them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
