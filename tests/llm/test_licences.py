"""The licence scan on labelled lines: as projects carry them, sentences that only speak of a licence, and look-alikes.

The first 46 lines and the mention frames of the module were looked at while it was made; CONTEXTS and the other lines were
first scored when it was done, then phrases like four of the five MENTIONED were added to it. "A lecture on" is unlike any.
"""

from wiregraph.llm import licenses

LINES = [
    ('mit', 'MIT License'),
    ('mit', 'Code released under MIT.'),
    ('gpl', 'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007'),
    ('mpl', 'Mozilla Public License Version 2.0'),
    ('apache', 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION'),
    ('gpl', 'You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ('cc-by-sa', 'available under the Creative Commons Attribution-ShareAlike License'),
    ('mit', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ('mit', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ('apache', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ('bsd', '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ('bsd', 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.'),
    ('gpl', 'GPLv2+ licensed'),
    ('cc-by-sa', 'Content on this site is CC BY-SA 4.0'),
    ('cc0', 'The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law'),
    ('mit', 'This project is licensed under the terms of the MIT license.'),
    ('', 'We are not licensed under the MIT license and never were'),
    ('', 'The history of the Apache License is a long one.'),
    ('', 'Unlike the GNU General Public License this one has no copyleft.'),
    ('', 'He reached the bus stop and all was free of charge for any person.'),
    ('mit', 'Licensed under the MIT License. See LICENSE for details.'),
    ('apache', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ('bsd', 'This software is released under the 3-Clause BSD License.'),
    ('lgpl', 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation'),
    ('agpl', 'Distributed under the GNU Affero General Public License v3.0.'),
    ('mpl', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ('isc', 'ISC License'),
    ('isc', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear'),
    ('zlib', "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ('cc-by', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
    ('cc-by-nc', 'Except where noted, text is under CC BY-NC 4.0.'),
    ('epl', 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0'),
    ('apache', 'SPDX-License-Identifier: Apache-2.0'),
    ('mit', 'license: MIT'),
    ('proprietary', '(c) 2020 Example Corp. All rights reserved.'),
    ('', 'The license plate was available on Tuesday.'),
    ('', 'Tickets are provided subject to availability.'),
    ('', 'MIT researchers published a new paper.'),
    ('', 'The eclipse was visible to the public.'),
    ('', 'An article about the Mozilla Public License appeared.'),
    ('', 'They chose another licence instead of the MIT License.'),
    ('bsd', 'BSD 2-Clause License'),
    ('gpl', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License'),
    ('apache', 'http://www.apache.org/licenses/LICENSE-2.0'),
    ('bsd', '* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.'),
    ('cc0', 'CC0 1.0 Universal'),
    ('mit', 'MIT Licensed.'),
    ('gpl', 'This package is distributed under the GNU GPL.'),
    ('lgpl', 'license: LGPL-2.1-or-later'),
    ('bsd', 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY'),
    ('cc-by', 'Photo released under CC BY 3.0'),
    ('eupl', 'Licensed under the EUPL-1.2'),
    ('mpl', 'Distributed under the Mozilla Public License, version 2.0'),
    ('zlib', '3. This notice may not be removed. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.'),
    ('mit', 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ('isc', 'This project is ISC licensed'),
    ('agpl', 'SPDX-License-Identifier: AGPL-3.0-only'),
    ('apache', 'Apache License, Version 2.0'),
    ('lgpl', 'This library is available under the GNU Lesser General Public License.'),
    ('epl', 'Published under the Eclipse Public License.'),
    ('', 'The free software conference was held in May.'),
    ('', 'This code was previously under the Apache License but is proprietary now.'),
    ('', 'Is the GNU GPL incompatible with the MIT License, lawyers ask.'),
    ('', 'Permission to enter the building is granted to any person.'),
    ('', 'All copies of the notice were distributed to members.'),
    ('', 'The source of the river is available to visitors.'),
    ('', 'The gnu is an antelope.'),
    ('', 'cc: the whole team'),
    ('', 'Redistribution of wealth is a subject of the talk.'),
    ('', 'The contributors waived their fee.'),
    ('', 'He bought the BSD book and read it without a licence.'),
    ('', 'Rather than the ISC License we wrote our own terms.'),
    ('', 'No longer licensed under the Mozilla Public License.'),
    ('gpl', 'You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.'),
    ('proprietary', 'Unauthorized copying of this file, via any medium is strictly prohibited'),
    ('cc-by-nc', 'This dataset is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License'),
    ('cc0', 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.'),
    ('apache', 'This file is licensed under the Apache Software License'),
    ('mit', 'Provided under the terms of the MIT license'),
    ('bsd', 'released under the new BSD license'),
]
CONTEXTS = ("Copyright 2019 The Authors. {}.", "The {} applies to this code.", "See LICENSE.txt ({}) in the root folder.", "Code: {}", "You can use this package under the {}.")
MENTIONED = ("We did not choose the {}.", "A lecture on the {} drew a crowd.", "Critics of the {} wrote a letter.", "It is not covered by the {}.", "They moved away from the {} last year.")


def test_labelled_lines(spark):
    lines = list(LINES)
    lines += [(f, c.format(n.title())) for f, names in licenses.NAMES.items() for n in names for c in CONTEXTS]
    lines += [("", c.format(names[0].title())) for names in licenses.NAMES.values() for c in MENTIONED]
    model = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    x = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    found = {(r["k_id"], r["family"]): r for r in licenses.scan(x, model).collect()}
    right = {(i, f) for i, (fs, _) in enumerate(lines) for f in fs.split(",") if f}
    sure = {k for k, r in found.items() if r["confirmed"]}
    assert len(lines) > 350 and len(sure & right) >= 0.9 * len(sure) and len(sure & right) >= 0.9 * len(right)
    # probabilities of the classes of a line add up to one at most
    total = {}
    for (i, _), r in found.items():
        total[i] = total.get(i, 0) + r["p"]
    assert max(total.values()) <= 1 + 1e-9
    # repeated rows and long paragraphs: reported alike, and found wherever they stand
    long = ("lorem ipsum dolor " * 900) + "licensed under the MIT license" + (" sit amet" * 900)
    y = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "x\n\n" + long + "\n\nMIT License")], "doc_id long, text string")
    got = {(r["k_id"], r["paragraph"], r["family"]) for r in licenses.scan(y, model).where("confirmed").collect()}
    assert got == {(1, 0, "mit"), (3, 1, "mit"), (3, 2, "mit")}
