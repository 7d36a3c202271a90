"""What the licence classifier learns from: short notices of each family, and sentences that only look like notices."""

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for details.",
        "This project is distributed under the terms of the MIT licence.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, provided the copyright notice is included.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "This software is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law, software distributed under the Apache License is distributed on an as is basis, without warranties.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL, version 2 or later.",
        "Released under GPLv3. See the license file.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL, version 3 or later.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL, version 3 or later.",
        "Released under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "This software is released under the two clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license conditions.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under the MPL 2.0 license.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "The text is available under the Creative Commons Attribution license.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike license.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons NonCommercial license, CC BY-NC 3.0.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright under CC0.",
        "This work is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright by the publisher. All rights reserved.",
        "No part may be reproduced without written permission. All rights reserved.",
    ],
}

#: Statements of terms that belong to none of the families.
OTHER = [
    "Licensed under the Example Commercial Agreement between the parties.",
    "This software is licensed, not sold, under the terms of the vendor agreement.",
    "Use is subject to the end user license agreement of the supplier.",
    "Licensed under terms that the company publishes on its site.",
    "See the license terms in the contract before use.",
    "Distributed under a custom source available license.",
    "Copyright holders may be contacted about the license of this text.",
    "SPDX-License-Identifier: LicenseRef-Internal",
]

#: Sentences with words of licences that state no terms.
PROSE = [
    "She renewed her driving licence last week at the town hall.",
    "The Apache helicopter landed near the village in the evening.",
    "Historians debate when copyright first became law in England.",
    "The pilot lost his license after the accident on the river.",
    "The new domain of the public library is easier to remember.",
    "The restaurant finally got its liquor license from the city.",
    "Mozilla moved its office to the other side of the bay.",
    "The warranty of the washing machine had run out in spring.",
    "A fishing license costs ten euros at the village shop.",
    "The course explains copyright and fair use to teachers.",
    "They reserved a table, and all rights of way were closed.",
    "Redistribution of income was the topic of the debate.",
]

#: Names of the families and of other terms.  With FORMS they make more examples to learn from; notices to compare with they are not.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT licence terms", "MIT"],
    "Apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "GPL": ["GNU General Public License, version 3", "GPLv3", "GPL-2.0"],
    "LGPL": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "two clause BSD license", "BSD-3-Clause"],
    "MPL": ["Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC BY 4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike license", "CC BY-SA 4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial license", "CC BY-NC 4.0"],
    "CC0": ["CC0 1.0 Universal dedication", "Creative Commons CC0 waiver", "CC0 1.0"],
    "reserved": [],
    "unknown": ["Example Commercial Agreement", "Boost Software License", "Eclipse Public License 2.0", "European Union Public Licence", "Artistic License", "vendor's evaluation terms", "EPL-2.0"],
}
FORMS = (
    "Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This work is licensed under the {}.", "License: {}", "SPDX-License-Identifier: {}",
    "This file is available under the {}; see the license file.", "The code of this project is published under the {}.",
)
RESERVED = ["Copyright 2021 by the authors. All rights reserved.", "(c) 2019 Example Inc. All rights reserved.", "All rights reserved by the publisher.", "Copyright the contributors, all rights reserved worldwide."]
