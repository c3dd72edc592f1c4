"""Full texts (``license_texts``) and notices of common licenses, beside the short ones.

Names are SPDX identifiers; an identifier without -only or -or-later is that of the text.
"""

from __future__ import annotations

from pathlib import Path


def _gnu(kind: str, version: str, what: str = "program", later: bool = True) -> str:
    """The notice that the license itself recommends."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    subject = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation"
    return f"{subject}{',' if later else '; only'} {which}"


_GPL, _LESSER, _LIBRARY, _AFFERO = (f"{k}General Public License" for k in ("", "Lesser ", "Library ", "Affero "))

NOTICES = {
    "GPL-2.0-only": _gnu(_GPL, "2", later=False),
    "GPL-3.0-or-later": _gnu(_GPL, "3"),
    "GPL-3.0-only": _gnu(_GPL, "3", later=False),
    "LGPL-2.0-or-later": _gnu(_LIBRARY, "2", "library"),
    "LGPL-2.1-or-later": _gnu(_LESSER, "2.1", "library"),
    "LGPL-3.0-or-later": _gnu(_LESSER, "3"),
    "AGPL-3.0-or-later": _gnu(_AFFERO, "3"),
    "AGPL-3.0-only": _gnu(_AFFERO, "3", later=False),
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


def texts() -> dict[str, str]:
    """NAME-text: the files of ``license_texts``; read where the scan is planned, not in tasks."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return {f"{f.stem}-text": f.read_text("utf-8") for f in files}
