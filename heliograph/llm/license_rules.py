"""Signature rules for licenses, in order of priority.

A line is ``label ; keyword ; pattern``. The pattern runs on lower-cased text, and only where the keyword occurs: one
word, or a part of one, that every match holds, since whatever stands between words may vary. Runs of white space and punctuation that may stand between words are written ``_``.
"""

NAMES = r"""
apache-2.0 ; apache ; apache_(?:software_)?(?:public_)?licen[sc]e_?(?:,_)?(?:version_|v\.?_?)?2(?:\.0)?
apache-1.1 ; apache ; apache_(?:software_)?licen[sc]e_?(?:version_|v\.?_?)?1\.1
apache-1.0 ; apache ; apache_(?:software_)?licen[sc]e_?(?:version_|v\.?_?)?1\.0
mit ; mit ; (?:the_)?\bmit_(?:open_source_)?licen[sc]e\b
mit ; permission ; permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy
mit-0 ; attribution ; \bmit_no_attribution\b
x11 ; x11 ; \bx11_licen[sc]e\b
expat ; expat ; \bexpat_licen[sc]e\b
isc ; isc ; \bisc_licen[sc]e\b
isc ; permission ; permission_to_use_copy_modify_and_or_distribute_this_software_for_any_purpose
bsd-4-clause ; bsd ; \b(?:4|four)_clause_bsd(?:_licen[sc]e)?\b
bsd-4-clause ; advertising ; all_advertising_materials_mentioning_features_or_use_of_this_software
bsd-3-clause ; bsd ; \b(?:3|three)_clause_bsd(?:_licen[sc]e)?\b
bsd-3-clause ; bsd ; \b(?:new|modified|revised)_bsd_licen[sc]e\b
bsd-3-clause ; endorse ; may_be_used_to_endorse_or_promote_products_derived_from_this_software
bsd-2-clause ; bsd ; \b(?:2|two)_clause_bsd(?:_licen[sc]e)?\b
bsd-2-clause ; bsd ; \b(?:simplified|freebsd)_bsd_licen[sc]e\b
bsd-0-clause ; bsd ; \b(?:0|zero)_clause_bsd(?:_licen[sc]e)?\b
bsd ; bsd ; \bbsd_(?:style_)?licen[sc]e\b
bsd ; redistribution ; redistribution_and_use_in_source_and_binary_forms
agpl-3.0 ; affero ; (?:gnu_)?affero_general_public_licen[sc]e(?:_as_published)?_?(?:,_)?(?:version_|v\.?_?)?3?
agpl-1.0 ; affero ; affero_general_public_licen[sc]e_?(?:version_|v\.?_?)1
lgpl-3.0 ; lesser ; (?:gnu_)?lesser_general_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)3
lgpl-2.1 ; lesser ; (?:gnu_)?lesser_general_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)2\.1
lgpl-2.0 ; library ; (?:gnu_)?library_general_public_licen[sc]e
lgpl ; lesser ; (?:gnu_)?lesser_general_public_licen[sc]e
gpl-3.0 ; general ; (?:gnu_)?general_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)3(?:\.0)?
gpl-2.0 ; general ; (?:gnu_)?general_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)2(?:\.0)?
gpl-1.0 ; general ; (?:gnu_)?general_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)1(?:\.0)?
gpl-3.0 ; gpl ; \bgpl_?v?3(?:\.0)?\b
gpl-2.0 ; gpl ; \bgpl_?v?2(?:\.0)?\b
lgpl-3.0 ; lgpl ; \blgpl_?v?3(?:\.0)?\b
lgpl-2.1 ; lgpl ; \blgpl_?v?2\.1\b
agpl-3.0 ; agpl ; \bagpl_?v?3(?:\.0)?\b
gfdl ; documentation ; (?:gnu_)?free_documentation_licen[sc]e
gfdl ; gfdl ; \bgfdl_?(?:v?1\.[123])?\b
mpl-2.0 ; mozilla ; mozilla_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)?2(?:\.0)?
mpl-1.1 ; mozilla ; mozilla_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)?1\.1
mpl-1.0 ; mozilla ; mozilla_public_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)?1\.0
npl ; netscape ; netscape_public_licen[sc]e
epl-2.0 ; eclipse ; eclipse_public_licen[sc]e_?(?:-_)?(?:,_)?(?:version_|v\.?_?)?2(?:\.0)?
epl-1.0 ; eclipse ; eclipse_public_licen[sc]e_?(?:-_)?(?:,_)?(?:version_|v\.?_?)?1(?:\.0)?
epl ; eclipse ; eclipse_public_licen[sc]e
edl ; eclipse ; eclipse_distribution_licen[sc]e
cpl-1.0 ; common ; \bcommon_public_licen[sc]e\b
cddl-1.1 ; common ; common_development_and_distribution_licen[sc]e_?(?:version_|v\.?_?)?1\.1
cddl-1.0 ; common ; common_development_and_distribution_licen[sc]e
cpal-1.0 ; common ; common_public_attribution_licen[sc]e
ipl-1.0 ; ibm ; \bibm_public_licen[sc]e\b
spl-1.0 ; sun ; \bsun_public_licen[sc]e\b
apsl-2.0 ; apple ; apple_public_source_licen[sc]e
ms-pl ; microsoft ; microsoft_public_licen[sc]e
ms-rl ; microsoft ; microsoft_reciprocal_licen[sc]e
eupl-1.2 ; european ; european_union_public_licen[sc]e_?(?:version_|v\.?_?)?1\.2
eupl ; european ; european_union_public_licen[sc]e
cecill ; cecill ; \bcecill(?:_[abc])?(?:_licen[sc]e)?\b
bsl-1.0 ; boost ; boost_software_licen[sc]e
busl-1.1 ; business ; business_source_licen[sc]e
sspl-1.0 ; server ; server_side_public_licen[sc]e
elastic-2.0 ; elastic ; \belastic_licen[sc]e(?:_2(?:\.0)?)?\b
confluent ; confluent ; confluent_community_licen[sc]e
commons-clause ; commons ; \bcommons_clause\b
polyform ; polyform ; polyform_(?:noncommercial|small_business|perimeter|shield|strict)
zlib ; zlib ; \bzlib(?:_libpng)?_licen[sc]e\b
libpng ; libpng ; \blibpng_licen[sc]e\b
zlib ; altered ; altered_source_versions_must_be_plainly_marked
unlicense ; unlicen ; \bthe_unlicen[sc]e\b
unlicense ; unencumbered ; free_and_unencumbered_software_released_into_the_public_domain
wtfpl ; wtfpl ; \bwtfpl\b
wtfpl ; what ; do_what_the_f\w*_you_want_to
beerware ; beer ; \bbeer_?ware\b
artistic-2.0 ; artistic ; artistic_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)?2(?:\.0)?
artistic-1.0 ; artistic ; artistic_licen[sc]e_?(?:,_)?(?:version_|v\.?_?)?1(?:\.0)?
artistic ; artistic ; \bartistic_licen[sc]e\b
psf-2.0 ; python ; python_software_foundation_licen[sc]e
python-2.0 ; python ; \bpython_licen[sc]e_?(?:version_|v\.?_?)?2
ruby ; ruby ; \bruby_licen[sc]e\b
php-3.01 ; php ; \bphp_licen[sc]e\b
perl ; perl ; same_terms_as_perl(?:_itself)?
openssl ; openssl ; \bopenssl_licen[sc]e\b
postgresql ; postgresql ; \bpostgresql_licen[sc]e\b
ofl-1.1 ; font ; (?:sil_)?open_font_licen[sc]e
ncsa ; ncsa ; (?:university_of_illinois_)?(?:/_)?ncsa_(?:open_source_)?licen[sc]e
w3c ; w3c ; \bw3c_(?:software_)?(?:notice_and_)?licen[sc]e\b
unicode ; unicode ; \bunicode_(?:dfs_|inc_)?licen[sc]e(?:_agreement)?\b
curl ; curl ; \bcurl_licen[sc]e\b
vim ; vim ; \bvim_licen[sc]e\b
tcl ; tcl ; \btcl(?:_tk)?_licen[sc]e\b
json ; evil ; software_shall_be_used_for_good_not_evil
afl-3.0 ; academic ; academic_free_licen[sc]e
osl-3.0 ; software ; open_software_licen[sc]e
upl-1.0 ; universal ; universal_permissive_licen[sc]e
ecl-2.0 ; educational ; educational_community_licen[sc]e
odbl-1.0 ; database ; open_database_licen[sc]e
odc-by-1.0 ; commons ; open_data_commons_attribution_licen[sc]e
pddl-1.0 ; domain ; public_domain_dedication_and_licen[sc]e
ogl-3.0 ; government ; open_government_licen[sc]e
openrail ; rail ; \b(?:creativeml_)?(?:bigscience_)?open_?rail(?:_m|_\+\+_m)?\b
llama ; llama ; \bllama_?[0-9.]*_community_licen[sc]e\b
cc0-1.0 ; cc0 ; \bcc0(?:_1\.0)?(?:_universal)?\b
cc0-1.0 ; commons ; creative_commons_(?:zero|cc0)
cc-by-nc-nd ; commons ; creative_commons_attribution_non_?commercial_no_?deriv(?:ative)?s?(?:_works)?
cc-by-nc-sa ; commons ; creative_commons_attribution_non_?commercial_share_?alike
cc-by-nc ; commons ; creative_commons_attribution_non_?commercial
cc-by-nd ; commons ; creative_commons_attribution_no_?deriv(?:ative)?s?(?:_works)?
cc-by-sa ; commons ; creative_commons_attribution_share_?alike
cc-by-4.0 ; commons ; creative_commons_attribution_4\.0
cc-by-3.0 ; commons ; creative_commons_attribution_3\.0
cc-by ; commons ; creative_commons_attribution
cc-by-nc-nd ; cc ; \bcc_by_nc_nd(?:_[1-4]\.[05])?\b
cc-by-nc-sa ; cc ; \bcc_by_nc_sa(?:_[1-4]\.[05])?\b
cc-by-nc ; cc ; \bcc_by_nc(?:_[1-4]\.[05])?\b
cc-by-nd ; cc ; \bcc_by_nd(?:_[1-4]\.[05])?\b
cc-by-sa ; cc ; \bcc_by_sa(?:_[1-4]\.[05])?\b
cc-by-4.0 ; cc ; \bcc_by_4\.0\b
cc-by-3.0 ; cc ; \bcc_by_3\.0\b
creative-commons ; commons ; \bcreative_commons\b
public-domain ; domain ; \b(?:in|into|to)_the_public_domain\b
public-domain ; domain ; \bpublic_domain\b
proprietary ; proprietary ; \bproprietary_and_confidential\b
proprietary ; confidential ; \bconfidential_and_proprietary\b
proprietary ; commercial ; \bcommercial_licen[sc]e(?:_agreement)?\b
proprietary ; user ; \bend_user_licen[sc]e_agreement\b
proprietary ; eula ; \beula\b
noncommercial ; non ; \bfor_non_?commercial_(?:use|purposes)(?:_only)?\b
no-derivatives ; derivative ; \bno_derivative_works\b
attribution ; attribution ; \battribution_(?:is_)?required\b
copyright ; copyright ; \bcopyright_(?:\(c\)_|©_)?(?:19|20)[0-9]{2}\b
copyright ; (c) ; \(c\)_(?:copyright_)?(?:19|20)[0-9]{2}\b
copyright ; © ; ©_?(?:19|20)[0-9]{2}\b
license-reference ; licen ; \b(?:released|licen[sc]ed|distributed|available|published)_under_(?:the_)?(?:terms_of_)?(?:the_)?[a-z0-9 .+-]{2,40}_licen[sc]e\b
license-reference ; licen ; \bsee_(?:the_)?(?:accompanying_)?licen[sc]e(?:_file|\.txt|\.md)?\b
"""

#: Identifiers as they stand after the tag ``SPDX-License-Identifier:``, and label of each where it isn't the same.
SPDX = """
apache-2.0 apache-1.1 apache-1.0 mit mit-0 x11 isc bsd-4-clause bsd-3-clause bsd-2-clause bsd-3-clause-clear 0bsd
agpl-3.0 agpl-3.0-only agpl-3.0-or-later gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
gpl-3.0-or-later lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later
gfdl-1.1 gfdl-1.2 gfdl-1.3 mpl-1.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cpl-1.0 cddl-1.0 cddl-1.1 cpal-1.0 ipl-1.0
spl-1.0 apsl-2.0 ms-pl ms-rl eupl-1.1 eupl-1.2 cecill-2.1 bsl-1.0 busl-1.1 sspl-1.0 elastic-2.0 zlib libpng
unlicense wtfpl beerware artistic-1.0 artistic-2.0 psf-2.0 python-2.0 ruby php-3.01 openssl postgresql ofl-1.1
ncsa w3c curl vim tcl json afl-3.0 osl-3.0 upl-1.0 ecl-2.0 odbl-1.0 odc-by-1.0 pddl-1.0 cc0-1.0 cc-by-1.0
cc-by-2.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0
cc-by-nc-nd-4.0
""".split()

URLS = r"""
apache-2.0 ; apache.org ; apache\.org/licenses/license-2\.0
apache-1.1 ; apache.org ; apache\.org/licenses/license-1\.1
mit ; opensource.org ; opensource\.org/licenses?/mit\b
bsd-3-clause ; opensource.org ; opensource\.org/licenses?/bsd-3-clause
bsd-2-clause ; opensource.org ; opensource\.org/licenses?/bsd-2-clause
isc ; opensource.org ; opensource\.org/licenses?/isc\b
artistic-2.0 ; opensource.org ; opensource\.org/licenses?/artistic-2\.0
gpl-3.0 ; gnu.org ; gnu\.org/licenses/gpl-3\.0
gpl-2.0 ; gnu.org ; gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
lgpl-3.0 ; gnu.org ; gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 ; gnu.org ; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
agpl-3.0 ; gnu.org ; gnu\.org/licenses/agpl(?:-3\.0)?
gfdl ; gnu.org ; gnu\.org/licenses/fdl
gnu ; gnu.org ; gnu\.org/licenses/?
mpl-2.0 ; mozilla.org ; mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 ; mozilla.org ; mozilla\.org/(?:en-us/)?mpl/1\.1
epl-2.0 ; eclipse.org ; eclipse\.org/(?:legal|org/documents)/epl-(?:v-?)?2\.?0
epl-1.0 ; eclipse.org ; eclipse\.org/(?:legal|org/documents)/epl-v10
bsl-1.0 ; boost.org ; boost\.org/license_1_0
unlicense ; unlicense.org ; \bunlicense\.org\b
wtfpl ; wtfpl.net ; \bwtfpl\.net\b
ofl-1.1 ; scripts.sil.org ; scripts\.sil\.org/ofl
cc0-1.0 ; creativecommons.org ; creativecommons\.org/publicdomain/zero/1\.0
public-domain ; creativecommons.org ; creativecommons\.org/publicdomain/mark/1\.0
cc-by-nc-nd ; creativecommons.org ; creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
cc-by-nc-sa ; creativecommons.org ; creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc ; creativecommons.org ; creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nd ; creativecommons.org ; creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-sa ; creativecommons.org ; creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by-4.0 ; creativecommons.org ; creativecommons\.org/licenses/by/4\.0
cc-by-3.0 ; creativecommons.org ; creativecommons\.org/licenses/by/3\.0
cc-by ; creativecommons.org ; creativecommons\.org/licenses/by/[12]\.[05]
odbl-1.0 ; opendatacommons.org ; opendatacommons\.org/licenses/odbl
odc-by-1.0 ; opendatacommons.org ; opendatacommons\.org/licenses/by
pddl-1.0 ; opendatacommons.org ; opendatacommons\.org/licenses/pddl
spdx ; spdx.org ; spdx\.org/licenses/[a-z0-9.-]+
"""


def table() -> list[tuple[str, str, str, float]]:
    """(label, keyword, pattern, confidence) by falling priority: tags, addresses, names.

    Where a pattern has a group, the detection is the group alone: one tag may stand before several identifiers.
    """
    tag = r"spdx-license-identifier:[ \t]*(?:[a-z0-9.() +-]*?[ (])?"
    rules = [(x, "spdx-license-identifier", tag + "(" + x.replace(".", r"\.") + r")(?![a-z0-9.-])", 1.0) for x in SPDX]
    for text, confidence in ((URLS, 0.95), (NAMES, 0.9)):
        for line in text.strip().splitlines():
            label, keyword, pattern = (x.strip() for x in line.split(" ; ", 2))
            weak = label in ("copyright", "license-reference", "public-domain", "proprietary", "attribution", "noncommercial", "no-derivatives", "gnu", "spdx")
            rules.append((label, keyword, pattern.replace("_", r"[\s,.:;()/\"'-]*") if confidence < 0.95 else pattern, 0.6 if weak else confidence))
    return rules
