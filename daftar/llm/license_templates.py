"""Wording of common licences: fixed public texts, by SPDX identifier.

``needs`` are words that tell a licence from its nearest kin; a block must have them
all, in order, to be confirmed.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    spdx: str
    passages: tuple[str, ...]
    needs: tuple[str, ...]


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

# Public licence notices.
TEMPLATES = (
    Template("MIT", (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software.""",
    ), ()),
    Template("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        "http://www.apache.org/licenses/LICENSE-2.0",
    ), ("apache", "2")),
    Template("GPL-3.0", (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ), ("3",)),
    Template("GPL-2.0", (
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ), ("2",)),
    Template("LGPL-3.0", (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ), ("3",)),
    Template("LGPL-2.1", (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ), ("2", "1")),
    Template("AGPL-3.0", (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License Version 3",
        "SPDX-License-Identifier: AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ), ("3",)),
    Template("BSD-2-Clause", ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD), ("2",)),
    Template("BSD-3-Clause", (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        _BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    ), ("3",)),
    Template("ISC", (
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    ), ()),
    Template("MPL-2.0", (
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ), ("2",)),
    Template("EPL-2.0", (
        "SPDX-License-Identifier: EPL-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at https://www.eclipse.org/legal/epl-2.0""",
    ), ("2",)),
    Template("BSL-1.0", (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ), ("1",)),
    Template("Zlib", (
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely""",
    ), ()),
    Template("CC-BY-4.0", (
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ), ("4",)),
    Template("CC-BY-SA-4.0", (
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ), ("4",)),
    Template("CC-BY-NC-4.0", (
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ), ("4",)),
    Template("CC0-1.0", (
        "Released under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain.",
    ), ()),
    Template("Unlicense", (
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ), ()),
    Template("LicenseRef-All-Rights-Reserved", (
        "All rights reserved.",
    ), ()),
)
