"""The labelled table of the licence scan: names and passages of the published licences, and what is none of them."""

# Names that licences go by, and paragraphs of their published texts and notices.
NAMES = {
    'Apache-2.0': ('Apache-2.0', 'Apache 2.0', 'Apache License 2.0', 'Apache License, Version 2.0', 'Apache v2 license', 'ALv2',),
    'MIT': ('MIT', 'MIT License', 'The MIT License (MIT)', 'Expat License',),
    'ISC': ('ISC', 'ISC License',),
    'BSD-2-Clause': ('BSD-2-Clause', 'BSD 2-Clause License', 'Simplified BSD License', 'FreeBSD License',),
    'BSD-3-Clause': ('BSD-3-Clause', 'BSD 3-Clause License', 'New BSD License', 'Modified BSD License', 'BSD license',),
    'Zlib': ('Zlib', 'zlib License',),
    'BSL-1.0': ('BSL-1.0', 'Boost Software License 1.0', 'Boost Software License - Version 1.0',),
    'Unlicense': ('Unlicense', 'The Unlicense',),
    'GPL-2.0': ('GPL-2.0', 'GPLv2', 'GPL v2', 'GPL-2.0-only', 'GPL-2.0-or-later', 'GNU General Public License, version 2', 'GNU GPL version 2',),
    'GPL-3.0': ('GPL-3.0', 'GPLv3', 'GPL v3', 'GPL-3.0-only', 'GPL-3.0-or-later', 'GNU General Public License, version 3', 'GNU GPL version 3', 'GNU General Public License v3.0',),
    'GPL': ('GPL', 'GNU General Public License', 'GNU GPL',),
    'LGPL-2.1': ('LGPL-2.1', 'LGPLv2.1', 'LGPL-2.1-or-later', 'GNU Lesser General Public License, version 2.1',),
    'LGPL-3.0': ('LGPL-3.0', 'LGPLv3', 'LGPL v3', 'LGPL-3.0-or-later', 'GNU Lesser General Public License, version 3',),
    'AGPL-3.0': ('AGPL-3.0', 'AGPLv3', 'AGPL v3', 'AGPL-3.0-or-later', 'GNU Affero General Public License, version 3', 'GNU AGPL version 3',),
    'MPL-2.0': ('MPL-2.0', 'MPL 2.0', 'Mozilla Public License 2.0', 'Mozilla Public License, v. 2.0', 'Mozilla Public License Version 2.0',),
    'EPL-2.0': ('EPL-2.0', 'EPL 2.0', 'Eclipse Public License 2.0', 'Eclipse Public License v2.0',),
    'CC0-1.0': ('CC0-1.0', 'CC0 1.0', 'CC0 1.0 Universal', 'Creative Commons Zero',),
    'CC-BY-4.0': ('CC-BY-4.0', 'CC BY 4.0', 'Creative Commons Attribution 4.0 International',),
    'CC-BY-SA-4.0': ('CC-BY-SA-4.0', 'CC BY-SA 4.0', 'Creative Commons Attribution-ShareAlike 4.0 International',),
    'CC-BY-NC-4.0': ('CC-BY-NC-4.0', 'CC BY-NC 4.0', 'Creative Commons Attribution-NonCommercial 4.0 International',),
    'CC-BY-ND-4.0': ('CC-BY-ND-4.0', 'CC BY-ND 4.0', 'Creative Commons Attribution-NoDerivatives 4.0 International',),
    'CC-BY-NC-SA-4.0': ('CC-BY-NC-SA-4.0', 'CC BY-NC-SA 4.0', 'Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International',),
}
BODIES = {
    'Apache-2.0': (
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
        '"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that'
        ' entity. For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity, '
        'whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of such '
        'entity.',
        '"Object" form shall mean any form resulting from mechanical transformation or translation of a Source form, including but not limited to compiled '
        'object code, generated documentation, and conversions to other media types.',
        '"Derivative Works" shall mean any work, whether in Source or Object form, that is based on (or derived from) the Work and for which the editorial '
        'revisions, annotations, elaborations, or other modifications represent, as a whole, an original work of authorship. For the purposes of this License, '
        'Derivative Works shall not include works that remain separable from, or merely link (or bind by name) to the interfaces of, the Work and Derivative '
        'Works thereof.',
        '"Contribution" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or '
        'Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner or by an individual or Legal '
        'Entity authorized to submit on behalf of the copyright owner. For the purposes of this definition, "submitted" means any form of electronic, verbal, '
        'or written communication sent to the Licensor or its representatives, including but not limited to communication on electronic mailing lists, source '
        'code control systems, and issue tracking systems that are managed by, or on behalf of, the Licensor for the purpose of discussing and improving the '
        'Work, but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright owner as "Not a Contribution."',
        '2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, '
        'non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, '
        'sublicense, and distribute the Work and such Derivative Works in Source or Object form.',
        '3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, '
        'non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, '
        'import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily '
        'infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted. If You '
        'institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution '
        'incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for '
        'that Work shall terminate as of the date such litigation is filed.',
        '4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and '
        'in Source or Object form, provided that You meet the following conditions:',
        '(c) You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from '
        'the Source form of the Work, excluding those notices that do not pertain to any part of the Derivative Works; and',
        '(d) If the Work includes a "NOTICE" text file as part of its distribution, then any Derivative Works that You distribute must include a readable copy '
        'of the attribution notices contained within such NOTICE file, excluding those notices that do not pertain to any part of the Derivative Works, in at '
        'least one of the following places: within a NOTICE text file distributed as part of the Derivative Works; within the Source form or documentation, if '
        'provided along with the Derivative Works; or, within a display generated by the Derivative Works, if and wherever such third-party notices normally '
        'appear. The contents of the NOTICE file are for informational purposes only and do not modify the License. You may add Your own attribution notices '
        'within Derivative Works that You distribute, alongside or as an addendum to the NOTICE text from the Work, provided that such additional attribution '
        'notices cannot be construed as modifying the License.',
        '5. Submission of Contributions. Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to '
        'the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions. Notwithstanding the above, nothing '
        'herein shall supersede or modify the terms of any separate license agreement you may have executed with Licensor regarding such Contributions.',
        '7. Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its '
        'Contributions) on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any '
        'warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining '
        'the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License.',
        '8. Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or otherwise, unless required by '
        'applicable law (such as deliberate and grossly negligent acts) or agreed to in writing, shall any Contributor be liable to You for damages, including '
        'any direct, indirect, special, incidental, or consequential damages of any character arising as a result of this License or out of the use or '
        'inability to use the Work (including but not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or any and all '
        'other commercial damages or losses), even if such Contributor has been advised of the possibility of such damages.',
        '9. Accepting Warranty or Additional Liability. While redistributing the Work or Derivative Works thereof, You may choose to offer, and charge a fee '
        'for, acceptance of support, warranty, indemnity, or other liability obligations and/or rights consistent with this License. However, in accepting such'
        ' obligations, You may act only on Your own behalf and on Your sole responsibility, not on behalf of any other Contributor, and only if You agree to '
        'indemnify, defend, and hold each Contributor harmless for any liability incurred by, or claims asserted against, such Contributor by reason of your '
        'accepting any such warranty or additional liability.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy'
        ' of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        'WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under'
        ' the License.',
    ),
    'MIT': (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
        'deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or'
        ' sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        'FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER '
        'LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS '
        'IN THE SOFTWARE.',
    ),
    'ISC': (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above '
        'copyright notice and this permission notice appear in all copies.',
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        'MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES '
        'WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN '
        'CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    'BSD-2-Clause': (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:',
        '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
        '2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation'
        ' and/or other materials provided with the distribution.',
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        'IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE '
        'LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE '
        'GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT'
        ' LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH'
        ' DAMAGE.',
    ),
    'BSD-3-Clause': (
        '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software '
        'without specific prior written permission.',
        '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or '
        'promote products derived from this software without specific prior written permission.',
        'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.',
        'Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without '
        'specific prior written permission.',
    ),
    'Zlib': (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        'the use of this software.',
        'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, '
        'subject to the following restrictions:',
        '1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a '
        'product, an acknowledgment in the product documentation would be appreciated but is not required.',
        '2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.',
        '3. This notice may not be removed or altered from any source distribution.',
    ),
    'BSL-1.0': (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by'
        ' this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        'Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        'The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, '
        'must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works '
        'are solely in the form of machine-executable object code generated by a source language processor.',
    ),
    'Unlicense': (
        'This is free and unencumbered software released into the public domain.',
        'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any '
        'purpose, commercial or non-commercial, and by any means.',
        'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the '
        'public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this '
        'dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    ),
    'GPL-2.0': (
        'GNU GENERAL PUBLIC LICENSE Version 2, June 1991',
        'The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended '
        'to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies '
        "to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation "
        'software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.',
        'When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the '
        'freedom to distribute copies of free software (and charge for this service if you wish), that you receive source code or can get it if you want it, '
        'that you can change the software or use pieces of it in new free programs; and that you know you can do these things.',
        'We protect your rights with two steps: (1) copyright the software, and (2) offer you this license which gives you legal permission to copy, distribute'
        ' and/or modify the software.',
        'Finally, any free program is threatened constantly by software patents. We wish to avoid the danger that redistributors of a free program will '
        'individually obtain patent licenses, in effect making the program proprietary. To prevent this, we have made it clear that any patent must be licensed'
        " for everyone's free use or not licensed at all.",
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free '
        'Software Foundation; either version 2 of the License, or (at your option) any later version.',
        'The precise terms and conditions for copying, distribution and modification follow.',
        '0. This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the '
        'terms of this General Public License. The "Program", below, refers to any such program or work, and a "work based on the Program" means either the '
        'Program or any derivative work under copyright law: that is to say, a work containing the Program or a portion of it, either verbatim or with '
        'modifications and/or translated into another language. (Hereinafter, translation is included without limitation in the term "modification".) Each '
        'licensee is addressed as "you".',
        'Activities other than copying, distribution and modification are not covered by this License; they are outside its scope. The act of running the '
        'Program is not restricted, and the output from the Program is covered only if its contents constitute a work based on the Program (independent of '
        'having been made by running the Program). Whether that is true depends on what the Program does.',
        'This General Public License does not permit incorporating your program into proprietary programs. If your program is a subroutine library, you may '
        'consider it more useful to permit linking proprietary applications with the library. If this is what you want to do, use the GNU Lesser General Public'
        ' License instead of this License.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by '
        'the Free Software Foundation.',
    ),
    'GPL-3.0': (
        'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007',
        'The GNU General Public License is a free, copyleft license for software and other kinds of works.',
        'The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU '
        'General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for '
        'all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work '
        'released this way by its authors. You can apply it to your programs, too.',
        'To protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights. Therefore, you have certain '
        'responsibilities if you distribute copies of the software, or if you modify it: responsibilities to respect the freedom of others.',
        'Developers that use the GNU GPL protect your rights with two steps: (1) assert copyright on the software, and (2) offer you this License giving you '
        'legal permission to copy, distribute and/or modify it.',
        "For the developers' and authors' protection, the GPL clearly explains that there is no warranty for this free software. For both users' and authors' "
        'sake, the GPL requires that modified versions be marked as changed, so that their problems will not be attributed erroneously to authors of previous '
        'versions.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free '
        'Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'Finally, every program is threatened constantly by software patents. States should not allow patents to restrict development and use of software on '
        'general-purpose computers, but in those that do, we wish to avoid the special danger that patents applied to a free program could make it effectively '
        'proprietary. To prevent this, the GPL assures that patents cannot be used to render the program non-free.',
        '"This License" refers to version 3 of the GNU General Public License.',
        'To "modify" a work means to copy from or adapt all or part of the work in a fashion requiring copyright permission, other than the making of an exact '
        'copy. The resulting work is called a "modified version" of the earlier work or a work "based on" the earlier work.',
        'To "propagate" a work means to do anything with it that, without permission, would make you directly or secondarily liable for infringement under '
        'applicable copyright law, except executing it on a computer or modifying a private copy. Propagation includes copying, distribution (with or without '
        'modification), making available to the public, and in some countries other activities as well.',
        'The GNU General Public License does not permit incorporating your program into proprietary programs. If your program is a subroutine library, you may '
        'consider it more useful to permit linking proprietary applications with the library. If this is what you want to do, use the GNU Lesser General Public'
        ' License instead of this License. But first, please read <https://www.gnu.org/licenses/why-not-lgpl.html>.',
    ),
    'GPL': (
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
        'You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 '
        'Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
        'You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free '
        'Software Foundation.',
    ),
    'LGPL-2.1': (
        'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999',
        '[This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version'
        ' number 2.1.]',
        'This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software '
        'Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully about whether this license or the '
        'ordinary General Public License is the better strategy to use in any particular case, based on the explanations below.',
        'We protect your rights with a two-step method: (1) we copyright the library, and (2) we offer you this license, which gives you legal permission to '
        'copy, distribute and/or modify the library.',
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the '
        'Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
        'This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
        'You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.,'
        ' 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA',
    ),
    'LGPL-3.0': (
        'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007',
        'This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, '
        'supplemented by the additional permissions listed below.',
        'As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General '
        'Public License.',
        'A "Combined Work" is a work produced by combining or linking an Application with the Library. The particular version of the Library with which the '
        'Combined Work was made is also called the "Linked Version".',
        'If you modify a copy of the Library, and, in your modifications, a facility refers to a function or data to be supplied by an Application that uses '
        'the facility (other than as an argument passed when the facility is invoked), then you may convey a copy of the modified version:',
        'The object code form of an Application may incorporate material from a header file that is part of the Library. You may convey such object code under '
        'terms of your choice, provided that, if the incorporated material is not limited to numerical parameters, data structure layouts and accessors, or '
        'small macros, inline functions and templates (ten or fewer lines in length), you do both of the following:',
        'You may convey a Combined Work under terms of your choice that, taken together, effectively do not restrict modification of the portions of the '
        'Library contained in the Combined Work and reverse engineering for debugging such modifications, if you also do each of the following:',
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the '
        'Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ),
    'AGPL-3.0': (
        'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007',
        'The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation '
        'with the community in the case of network server software.',
        "A secondary benefit of defending all users' freedom is that improvements made in alternate versions of the program, if they receive widespread use, "
        'become available for other developers to incorporate.',
        'The GNU Affero General Public License is designed specifically to ensure that, in such cases, the modified source code becomes available to the '
        'community. It requires the operator of a network server to provide the source code of the modified version running there to the users of that server.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the '
        'Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
        'You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    ),
    'MPL-2.0': (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can '
        'obtain one at http://mozilla.org/MPL/2.0/.',
        '1.4. "Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such '
        'Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.',
        '(b) that the Covered Software was made available under the terms of version 1.1 or earlier of the License, but not also under the terms of a Secondary'
        ' License.',
        '1.11. "Patent Claims" of a Contributor means any patent claim(s), including without limitation, method, process, and apparatus claims, in any patent '
        'Licensable by such Contributor that would be infringed, but for the grant of the License, by the making, using, selling, offering for sale, having '
        'made, import, or transfer of either its Contributions or its Contributor Version.',
        '1.12. "Secondary License" means either the GNU General Public License, Version 2.0, the GNU Lesser General Public License, Version 2.1, the GNU Affero'
        ' General Public License, Version 3.0, or any later versions of those licenses.',
        'Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:',
        '(a) under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, '
        'display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work;'
        ' and',
        '(b) under Patent Claims of such Contributor to make, use, sell, offer for sale, have made, import, and otherwise transfer either its Contributions or '
        'its Contributor Version.',
        'The licenses granted in this Section 2 are the only rights granted under this License. No additional rights or licenses will be implied from the '
        'distribution or licensing of Covered Software under this License. Notwithstanding Section 2.1(b) above, no patent license is granted by a Contributor:',
        '2.5. Representation',
        'Sections 3.1, 3.2, 3.3, and 3.4 are conditions of the licenses granted in Section 2.1.',
    ),
    'EPL-2.0': (
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE '
        "PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at '
        'https://www.eclipse.org/legal/epl-2.0/',
        'This Source Code may also be made available under the following Secondary Licenses when the conditions for such availability set forth in the Eclipse '
        'Public License, v. 2.0 are satisfied',
    ),
    'CC0-1.0': (
        'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and '
        'subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").',
        'Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific'
        ' works ("Commons") that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse'
        ' and redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation commercial purposes. These owners '
        'may contribute to the Commons to promote the ideal of a free culture and the further production of creative, cultural and scientific works, or to gain'
        ' reputation or greater distribution for their Work in part through the use and efforts of others.',
        'For these and/or other purposes and motivations, and without any expectation of additional consideration or compensation, the person associating CC0 '
        'with a Work (the "Affirmer"), to the extent that he or she is an owner of Copyright and Related Rights in the Work, voluntarily elects to apply CC0 to'
        ' the Work and publicly distribute the Work under its terms, with knowledge of his or her Copyright and Related Rights in the Work and the meaning and '
        'intended legal effect of CC0 on those rights.',
        '1. Copyright and Related Rights. A Work made available under CC0 may be protected by copyright and related or neighboring rights ("Copyright and '
        'Related Rights"). Copyright and Related Rights include, but are not limited to, the following:',
        'a. No trademark or patent rights held by Affirmer are waived, abandoned, surrendered, licensed or otherwise affected by this document. b. Affirmer '
        'offers the Work as-is and makes no representations or warranties of any kind concerning the Work, express, implied, statutory or otherwise, including '
        'without limitation warranties of title, merchantability, fitness for a particular purpose, non infringement, or the absence of latent or other '
        'defects, accuracy, or the present or absence of errors, whether or not discoverable, all to the greatest extent permissible under applicable law. c. '
        'Affirmer disclaims responsibility for clearing rights of other persons that may apply to the Work or any use thereof, including without limitation any'
        " person's Copyright and Related Rights in the Work. Further, Affirmer disclaims responsibility for obtaining any necessary consents, permissions or "
        'other rights required for any use of the Work. d. Affirmer understands and acknowledges that Creative Commons is not a party to this document and has '
        'no duty or obligation with respect to this CC0 or use of the Work.',
        'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
        'The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide '
        'under copyright law.',
    ),
    'CC-BY-4.0': (
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution '
        '4.0 International Public License ("Public License").',
        'This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit '
        'http://creativecommons.org/licenses/by/4.0/.',
    ),
    'CC-BY-SA-4.0': (
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons '
        'Attribution-ShareAlike 4.0 International Public License ("Public License").',
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit '
        'http://creativecommons.org/licenses/by-sa/4.0/.',
    ),
    'CC-BY-NC-4.0': (
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons '
        'Attribution-NonCommercial 4.0 International Public License ("Public License").',
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit '
        'http://creativecommons.org/licenses/by-nc/4.0/.',
    ),
    'CC-BY-ND-4.0': (
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons '
        'Attribution-NoDerivatives 4.0 International Public License ("Public License").',
        'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit '
        'http://creativecommons.org/licenses/by-nd/4.0/.',
    ),
    'CC-BY-NC-SA-4.0': (
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons '
        'Attribution-NonCommercial-ShareAlike 4.0 International Public License ("Public License").',
        'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of this license, visit '
        'http://creativecommons.org/licenses/by-nc-sa/4.0/.',
    ),
    'Proprietary': (
        'Copyright 1999 Foo. All rights reserved.',
        'All Rights Reserved',
        '(c) 2004 by the author, all rights reserved',
        'Copyright (C) 1996-2003 The Example Company, all rights reserved worldwide.',
        'Text and pictures: all rights reserved.',
        'All rights reserved.',
        'Copyright 2020 Example Inc. All rights reserved.',
        'No part of this publication may be reproduced, stored or transmitted in any form or by any means without the prior written permission of the '
        'publisher.',
        'This software is the confidential and proprietary information of Example Inc. You shall not disclose such confidential information and shall use it '
        'only in accordance with the terms of the license agreement.',
        'Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.',
    ),
}
#: Licences that have no family here: they stand for what the scan calls unknown.
UNKNOWN_NAMES = (
    "Acme Public License", "Example Source License, version 1.1", "Foo End User License Agreement", "Bar Community License 2.0", "Quux Software License v3", "LicenseRef-Own",
    "Open Widget License", "Sleepycat License", "Server Side Public License, version 1", "Business Source License 1.1", "Artistic License 2.0", "Ruby License",
    "Microsoft Public License (MS-PL)", "Sun Industry Standards Source License", "Academic Free License 3.0", "Open Font License 1.1",
)
UNKNOWN_BODIES = (
    "You may use this library in your own products, provided that you do not sell the library by itself and that you mention its author in the manual.",
    "This license lets you install one copy of the program on one computer. You may not rent, lease or lend the program, and you may not reverse engineer it.",
    "The licensee shall indemnify the licensor against all claims that arise from use of the licensed material outside the field of use.",
    "This package is distributed under its own licence, whose terms are found in the file COPYING.", "see the LICENSE file for the licence of this work",
    "This work is licensed under its own licence.", "Permission to copy this document for private study is granted if the author is told of it.",
    "By downloading the data you agree to the terms of use of the institute, which allow research but no other use.",
    "The software may be used for evaluation only; a licence key is needed for production use, and all other rights stay with the vendor.",
    "Copies of the drawings may be made by members of the society under the licence that the society grants each year.",
    "Use, duplication or disclosure by the government is subject to restrictions of the licence as set out by the vendor.",
    "You are granted a limited, revocable, non-transferable licence to view the pages of this site.",
)
#: Text that grants nothing, though it may use the same words.
NONE = (
    "the driver lost his license last year", "they were licensed to sell fish in the market", "a copyright claim was heard in court", "the warranty of the car ran out in May",
    "the licence fee pays for the radio", "the doctor is licensed in two states", "permission to land was granted at noon", "the apache helicopter flew over the mit campus",
    "he holds a license for the restaurant", "the public domain of maths is large", "works of the creative commons club were shown", "she studied at MIT and then at Stanford",
    "the version 2.0 of the file was released in May", "version 3 of the library is faster than version 2", "the foundation published a general report for the public",
    "the software was written in Java and is used by many people", "a new source of water was found and its use is free of charge", "the terms of the contract were not met",
    "a boost to the economy", "the artistic director left the theatre", "the eclipse was seen by the public in the north", "mozilla released a browser in 2004",
    "the conditions on the road were bad and the following notice was put up", "all rights of way are kept open", "the rights of the people are reserved in the constitution",
    "we installed the server and the network without any trouble", "the patient was free of pain and in no event was a second dose given", "the court found the author liable for damages",
    "this notice hangs on the wall of the office", "a person who obtains a copy of the newspaper can read the story", "the above figure shows the binary forms of the number",
    "redistribution of wealth was the aim of the new law", "the names of its contributors are printed on the last page", "return the value that is provided by the caller",
    "def main(argc, argv): return run(source, binary, version=2)", "import apache_beam as beam", "#include <boost/version.hpp>", "npm install --save mit-app",
    "the merchant sold goods for a particular purpose", "the copy of the painting was sold for a fee", "the source code of life is written in four letters", "a permission bit is set on the file",
    "The committee reserved a room for the general meeting of the public library", "this document describes the use of the system and its limits", "the work was done by hand",
    "the university and its contributors paid for the new building", "the state of the art in modern networks", "the price is subject to change without notice", "to whom it may concern",
    "You should have received an email with a link; if not, see the help page", "the file is distributed over many disks", "the author disclaims any knowledge of the plot",
    "each individual or legal entity pays a tax", "the object form of the verb", "the licence plate of the car was read by the camera", "a driving licence is needed to rent a car",
    "mit freundlichen gruessen", "er geht mit dem hund und mit der katze in den park", "Zusammen mit 2 Freunden", "mit einem Wort", "wir fahren mit der bahn", "und mit der zeit",
    "mit", "un an et demi avec la copie", "la version de la fin", "el uso de la fuente", "con 3 copias de la obra",
    "gpl stands for gallons per lap in that table", "the isc meets on mondays", "cc the manager on the mail by noon", "the bsd lab closes at five", "zlib compresses the stream at level six",
)
