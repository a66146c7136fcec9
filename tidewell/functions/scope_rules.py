"""Rule tables of the scope decision: fixed values, in the order in which they are tried.

Texts are folded first: lower case, no accents, words of ``[a-z0-9+#]`` between single blanks,
a blank at both ends. A pattern is written as its alternatives."""

from __future__ import annotations


def _any(*alternatives: str) -> str:
    return "|".join(alternatives)


#: Disciplines by precedence, specific before general.
DISCIPLINES = (
    "security", "robotics", "aerospace_engineering", "biomedical_engineering", "mechanical_engineering", "hardware", "materials_engineering", "chemical_engineering", "civil_engineering",
    "manufacturing_engineering", "machine_learning", "quantitative", "data", "infrastructure", "design", "product_management", "software_engineering",
)
#: Early-career types by precedence.
TYPES = ("co_op", "internship", "apprenticeship", "rotational", "graduate_program", "new_grad")
#: Pieces of evidence that a decision keeps; how many categories and employment types a title keeps.
EVIDENCE, CATEGORIES, EMPLOYMENTS = 24, 20, 10
VERSION = "early-career-technical-scope-v3"

#: The patterns of titles and of how an applicant tracking system files a posting.
STAFF = (
    r"\b(?:interns?|internships?|early careers?|university|campus|students?|graduates?|new grads?) (?:program(?:me)?s? )?"
    r"(?:specialists?|coordinators?|recruit\w*|managers?|leads?|partners?|advisors?|experience|relations|ambassadors?)\b"
)
CONTRACT = _any(r"\bcontract(?:or|ors)?\b", r"\btemporary\b", r"\btemp\b", r"\bfreelance\w*\b", r"\bfixed term\b", r"\bbefristet\w*\b")
APPRENTICESHIP = _any(r"\bapprentices?\b", r"\bapprenticeships?\b", r"\bausbildung\b", r"\bauszubildende[rn]?\b")
CO_OP = _any(r"\bco ?ops?\b", r"\bduales studium\b", r"\bdual study\b", r"\bwork study\b")
INTERNSHIP = _any(
    r"\binterns?\b", r"\binternships?\b", r"\bworking students?\b", r"\bwerkstudent(?:in)?\b", r"\bpraktik(?:um|ant|antin)\b", r"\bpflichtpraktikum\b", r"\bpracticas\b", r"\bpracticum\b",
    r"\bestagi(?:o|ario|aria)\b", r"\bstagiaire\b", r"\btirocinio\b", r"\bgyakornok\b", r"\bstagiair\b", r"\bthesis\b", r"\bindustrial placement\b", r"\bplacement year\b",
    r"\bstudent (?:researcher|engineer|developer|scientist|worker|assistant|programmer)s?\b",
)
ROTATIONAL = r"\brotation(?:al)?\b"
NEW_GRAD = _any(r"\bnew grads?\b", r"\bnew graduates?\b", r"\b(?:university|college|recent) grad(?:uate)?s?\b", r"\b20\d\d grads\b")
JUNIOR = _any(r"\bjunior\b", r"\bjr\b")
APM_PROGRAM = _any(r"\bassociate product managers?\b", r"\bapms?\b", r"\brotational product managers?\b")
APM_ABBREVIATION = r"\bapms?\b"
OTHER_ROLE_NOUN = r"\b(?:engineer\w*|engineering|developer\w*|programmer\w*|scientist\w*|designer\w*|analysts?|architect\w*|managers?|specialists?|consultants?|monitoring)\b"
GRADUATE_PROGRAM = _any(r"\bgraduate (?:program(?:me)?|scheme)s?\b", r"\bgrad program(?:me)?s?\b", r"\btrainee(?: program(?:me)?)?s?\b")
BARE_GRADUATE = r"\bgraduates?\b(?! (?:students?|schools?|degrees?|levels?|studies|study)\b)"
TYPE_RULES = (
    ("co_op", "co_op", CO_OP),
    ("internship", "internship", INTERNSHIP),
    ("rotational", "rotational", ROTATIONAL),
    ("new_grad", "new_grad", NEW_GRAD),
    ("apprenticeship", "apprenticeship", APPRENTICESHIP),
    ("new_grad", "associate_product_manager_program", APM_PROGRAM),
    ("graduate_program", "graduate_program", GRADUATE_PROGRAM),
    ("new_grad", "junior", JUNIOR),
)
GENERIC_EARLY_CAREER = _any(r"\bearly careers?\b", r"\bentry level\b", r"\bcampus (?:hire|full time)\b")
SENIORITY = (
    r"\b(?:senior|sr|staff|principal|lead|leader|head of|director|vp|vice president|chief"
    r"|(?<!account )(?<!sales )executive(?! assistants?\b)|distinguished|expert|mid level|experienced)\b"
)
PRODUCT_OR_PROGRAM_MANAGER = r"\b(?:\w+ )?(?:product|program) managers?\b"
MANAGER = r"\bmanagers?\b"
NAVIGATION = (
    r"^ (?:(?:internships?|interns|early|careers?|students|university|graduates|programs?|opportunities|tracker"
    r"|jobs|overview|and|at|our|for|the|join|us|explore|all|open|roles) )+$"
)
CONTENT_LABEL = (
    r"\b(?:experience as|day in the life|meet (?:our|the)|stor(?:y|ies)|blog|webinar|podcast|faq|what it s like"
    r"|life at|tips for|insights?|spotlights?|frequently asked questions|intern(?:ship)? (?:experience|journey)|journey as|s guide to)\b"
)
NAVIGATION_PLURAL = r"\b(?:internships|interns|careers|students|graduates|programs|opportunities|tracker|jobs|overview|roles)\b"
TECH_NOUN = (
    r"\b(?:engineer\w*|developer\w*|programmer\w*|scientist\w*|researcher\w*|research|technologist\w*"
    r"|technicians?|architect\w*|interns?|internships?|co ?ops?|apprentices?|apprenticeships?)\b"
)
#: Rules that name the role itself: discipline, rule, pattern.
STRONG = (
    ("security", "security_engineering", _any(
        r"\bcyber ?security\b", r"\binfosec\b", r"\bappsec\b", r"\bsecurity (?:engineer\w*|research\w*|software)\b", r"\b(?:application|product|offensive|network|cloud|infrastructure|platform) security\b",
        r"\bdetection (?:and )?response\b", r"\bpenetration test\w*\b", r"\bred team\w*\b", r"\bthreat (?:intelligence|detection|research)\b", r"\bvulnerability research\w*\b")),
    ("robotics", "robotics_controls_autonomy", _any(
        r"\brobotic\w*\b", r"\bcontrols? (?:engineer\w*|systems?|software)\b", r"\bmotion planning\b", r"\bperception (?:engineer\w*|software)\b", r"\bmechatronic\w*\b", r"\bgnc\b", r"\bguidance navigation\b",
        r"\bautonomy (?:engineer\w*|software)\b", r"\bautonomous (?:systems?|vehicles?|driving)\b")),
    ("hardware", "hardware_electrical_embedded", _any(
        r"\bhardware\b", r"\belectrical (?:systems? )?(?:engineer\w*|integration)\b", r"\belectronics? engineer\w*\b", r"\bembedded\b", r"\bfirmware\b", r"\bfpga\b", r"\basic\b", r"\bsilicon\b", r"\bchip design\b",
        r"\banalog\b", r"\bmixed signal\b", r"\brf (?:engineer\w*|design)\b", r"\bpcb\b", r"\bcircuit design\b", r"\bic design\b", r"\bvlsi\b", r"\bdesign verification\b", r"\bphysical design\b", r"\bdigital design\b",
        r"\bsignal integrity\b", r"\bpower electronics\b", r"\bsemiconductor\b", r"\bavionics\b", r"\boptical engineer\w*\b", r"\bphotonics\b",
        r"(?<!software )(?<!automation )(?<!qa )(?<!ux )\btest engineer\w*\b", r"\b(?:product|regulatory) compliance engineer\w*\b", r"\bemc engineer\w*\b")),
    ("machine_learning", "machine_learning_ai", _any(
        r"\bmachine learning\b", r"\bdeep learning\b", r"\bcomputer vision\b", r"\bnatural language processing\b", r"\bnlp\b", r"\bllms?\b", r"\bgen ?ai\b", r"\bgenerative ai\b", r"\bapplied (?:scientist|science)\b",
        r"\bresearch scientist\w*\b", r"\bresearch engineer\w*\b", r"\bartificial intelligence\b", r"\breinforcement learning\b",
        r"\b(?:ai|ml)(?: (?:platform|infrastructure|research|systems?|product|applied|ops|software|safety))? (?:engineer\w*|research\w*|scientist\w*|developer\w*)\b")),
    ("quantitative", "quantitative", _any(
        r"\bquants?\b", r"\bquantitative\b(?! (?:ux|user) )", r"\btraders?\b", r"\btrading (?:interns?|internships?|analysts?)\b", r"\balgorithm(?:ic)? (?:development|trading)\b")),
    ("data", "data_analyst", r"\bdata analysts?\b"),
    ("data", "data_engineering_science", _any(r"\bdata (?:engineer\w*|scien\w*|analytics|platform engineer\w*|infrastructure)\b", r"\banalytics engineer\w*\b")),
    ("infrastructure", "infrastructure_platform_systems", _any(
        r"\binfrastructure\b", r"\bplatform engineer\w*\b", r"\bsite reliability\b", r"\bsre\b", r"\bdevops\b", r"\bsystems? engineer\w*\b", r"\bcloud (?:engineer\w*|infrastructure|platform)\b",
        r"\bnetwork engineer\w*\b", r"\bproduction engineer\w*\b", r"\bbuild (?:and )?release\b", r"\bdistributed systems\b", r"\bkernel\b", r"\bstorage (?:engineer\w*|systems)\b", r"\bdatabase engineer\w*\b", r"\bcompilers?\b")),
    ("design", "product_ux_design", _any(
        r"\bproduct design\w*\b", r"\bux\b", r"\bui designers?\b", r"\buser experience\b", r"\buser research\w*\b", r"\binteraction design\w*\b", r"\bdesign engineer\w*\b", r"\bdesign technologist\w*\b")),
    ("product_management", "product_management", _any(
        r"\b(?:associate |rotational |technical )?product manag(?:er|ers|ement)\b", r"\bapms?\b", r"\b(?:technical|engineering) program manag(?:er|ers|ement)\b", r"\btpms?\b")),
    ("mechanical_engineering", "mechanical_engineering", _any(
        r"\bmechanical (?:design )?(?:engineer\w*|design\w*|systems?|integration)\b", r"\bmechanical engineering\b", r"\bthermal (?:engineer\w*|systems?)\b", r"\bhvac engineer\w*\b")),
    ("aerospace_engineering", "aerospace_engineering", _any(
        r"\baerospace\b", r"\baeronautic\w*\b", r"\bastronautic\w*\b", r"\bpropulsion\b", r"\bspacecraft\b", r"\bflight (?:test|sciences?|dynamics|software)\b", r"\bstructures engineer\w*\b")),
    ("manufacturing_engineering", "manufacturing_process", _any(
        r"\bmanufacturing (?:engineer\w*|technolog\w*|process\w*|systems?|design)\b", r"\bprocess engineer\w*\b", r"\bprocess development engineer\w*\b", r"\bindustrial engineer\w*\b",
        r"(?<!software )(?<!automation )(?<!qa )\bquality engineer\w*\b", r"\bsupplier quality\b", r"\bwelding engineer\w*\b", r"\btooling engineer\w*\b", r"\bmetrolog\w*\b", r"\bindustrial engineering\b",
        r"\bwirtschaftsingenieur\w*\b", r"\bengenharia (?:e gestao )?(?:de operacoes|industrial)\b")),
    ("materials_engineering", "materials_engineering", _any(
        r"\bmaterials? (?:engineer\w*|scien\w*|characterization)\b", r"\bmetallurg\w*\b", r"\bpolymer (?:engineer\w*|scien\w*)\b", r"\bfailure analysis\b", r"\bcorrosion engineer\w*\b")),
    ("chemical_engineering", "chemical_engineering", _any(r"\bchemical (?:process )?engineer\w*\b", r"\bchemical engineering\b", r"\belectrochemi\w*\b", r"\bcell chemistry\b")),
    ("civil_engineering", "civil_engineering", _any(
        r"\bcivil (?:engineer\w*|engineering)\b", r"\bstructural engineer\w*\b", r"\bgeotechnical\b", r"\bconstruction engineer\w*\b", r"\benvironmental engineer\w*\b", r"\btransportation engineer\w*\b")),
    ("biomedical_engineering", "biomedical_engineering", _any(r"\bbiomedical\b", r"\bbio ?engineer\w*\b", r"\bbioengineering\b", r"\bmedical device engineer\w*\b")),
    ("software_engineering", "software_engineering", _any(
        r"\bsoftware (?:(?:test|quality|qa|development|engineering|systems?|applications?|platform|embedded|backend|frontend|infrastructure|reliability|security|tools|data|ml|ai|mobile|web|game) )?(?:engineer\w*|develop(?:er|ers|ment))\b",
        r"\bswe\b", r"\bsde\b", r"\bsdet\b",
        r"\b(?:back ?end|front ?end|full ?stack|mobile|ios|android|web|game(?:play)?|engine|tools|graphics|client|server) (?:software )?(?:engineer\w*|developer\w*|programmer\w*)\b",
        r"\bprogrammer\w*\b", r"\bdeveloper interns?\b", r"\bsoftware ?entwickl\w*\b", r"\b(?:automation|software|qa|manual) testers?\b", r"\bsoftware testing\b", r"\btest automation\b", r"\bqa engineer\w*\b",
        r"\bdeveloppeur\w*\b", r"\blogiciels?\b")),
)
#: Rules that abstain next to a function word.
BOUNDARY_RULES = ("product_management", "product_ux_design", "data_analyst", "manufacturing_process")
#: Topics tell a discipline beside a technical noun in a title, and on their own in a filing: discipline, rule, pattern.
TOPICS = (
    ("security", "security_topic", r"\bsecurity\b"),
    ("robotics", "autonomy_topic", _any(r"\bautonom\w*\b", r"\bcontrols\b", r"\bperception\b")),
    ("hardware", "electrical_topic", _any(r"\belectrical\b", r"\belectronics?\b", r"\biot\b")),
    ("machine_learning", "ai_ml_topic", _any(r"\bai\b", r"\bml\b")),
    ("quantitative", "trading_topic", r"\btrading\b"),
    ("data", "data_topic", _any(r"\bdata\b", r"\banalytics\b")),
    ("mechanical_engineering", "mechanical_topic", r"\bmechanical\b"),
    ("manufacturing_engineering", "manufacturing_topic", r"\bmanufacturing\b"),
    ("materials_engineering", "materials_topic", r"\bmaterials\b"),
    ("chemical_engineering", "chemical_topic", r"\bchemical\b"),
    ("civil_engineering", "civil_topic", _any(r"\bcivil\b(?! liberties)", r"\bstructural\b")),
    ("infrastructure", "infrastructure_topic", _any(r"\bplatforms?\b", r"\bcloud\b", r"\bsystems\b", r"\breliability\b")),
    ("software_engineering", "software_topic", _any(
        r"\bsoftware\b", r"\bbackend\b", r"\bfrontend\b", r"\bfull ?stack\b", r"\bmobile\b", r"\bios\b", r"\bandroid\b", r"\bc\+\+", r"\bpython\b", r"\bjava\b", r"\bgolang\b", r"\brust\b")),
)
FUNCTION = _any(
    r"\bsales\b", r"\baccount (?:executive|manager|management|development|director)s?\b", r"\baccounts? (?:payable|receivable)\b", r"\bbusiness development\b", r"\bbdrs?\b", r"\bsdrs?\b", r"\bgo to market\b",
    r"\bgtm\b", r"\bmarketing\b", r"\bbrand (?:manager|marketing|strategy|partnerships?)\b", r"\bcommunications\b", r"\bpublic relations\b", r"\brecruit\w*\b", r"\btalent (?:acquisition|partner|sourc\w*)\b",
    r"\bsourcers?\b", r"\bpeople (?:partner|operations|ops|team|programs?)\b", r"\bhuman resources\b", r"\bhr\b", r"\bfinance\b", r"\bfinancial\b", r"\baccounting\b", r"\baccountants?\b", r"\baudit\w*\b", r"\btax\b",
    r"\btreasury\b", r"\bpayroll\b", r"\bcredit\b", r"\brisk analyst\w*\b", r"\bunderwrit\w*\b", r"\bactuar\w*\b", r"\binvestment\w*\b", r"\bventures?\b", r"\bdeals?\b", r"\blegal\b", r"\bcounsel\b", r"\bparalegal\b",
    r"\bcompliance\b", r"\bregulatory\b", r"\boperations\b", r"\bops\b", r"\blogistics\b", r"\bsupply chain\b", r"\bprocurement\b", r"\bpurchasing\b",
    r"\bcustomer (?:engineer\w*|success|support|experience|service|care|enablement|onboarding)\b", r"\bsupport (?:engineer\w*|specialist|technician|agent|analyst)s?\b", r"\btechnical support\b", r"\bhelp ?desk\b",
    r"\bit (?:support|specialist|technician|helpdesk)\b", r"\bsolutions? (?:engineer\w*|consultant|architect|specialist)s?\b", r"\bsales engineer\w*\b", r"\bfield (?:engineer\w*|marketing|sales|application\w*)\b",
    r"\bimplementation (?:consultant|engineer\w*|specialist|manager)s?\b", r"\bprofessional services\b", r"\bconsult\w*\b", r"\bstrategy\b", r"\bstrategists?\b", r"\bbusiness analysts?\b", r"\bcoordinators?\b",
    r"\badministrat\w*\b", r"\bassistants?\b", r"\breceptionist\b", r"\bfacilities\b", r"\bevents? (?:manager|coordinator|marketing|intern)\b", r"\bcontent (?:writer|strategist|marketing|creator)s?\b",
    r"\bcopywrit\w*\b", r"\beditor\w*\b", r"\bsocial media\b", r"\bcommunity (?:manager|management|support)\b", r"\bpartnerships?\b", r"\bpolicy\b", r"\beconomists?\b",
    r"\bproduct (?:marketing|operations|specialist|support)\b", r"\bchief of staff\b", r"\bgrowth\b", r"\btrust (?:and )?safety\b", r"\bwarehouse\b", r"\bdrivers?\b", r"\bfulfil+ment\b", r"\bcashier\b", r"\bbarista\b",
    r"\bchef\b", r"\bcook\b", r"\bnurse\b", r"\bpharmac\w*\b", r"\bclinical\b", r"\bteachers?\b", r"\btutors?\b", r"\bjournalis\w*\b", r"\bwriters?\b", r"\bexecutive assistant\b", r"\bdeployment strategist\w*\b",
    r"\bsustainability\b", r"\blearning (?:and )?development\b", r"\bjunior managers? program\w*\b", r"\bmanagement trainee\w*\b", r"(?<!technical )(?<!engineering )\bprogram managers?\b",
    r"\beinkauf\w*\b", r"\bpersonal(?:management|entwicklung|wesen|abteilung|referent\w*)\b", r"\bcontrolling\b", r"\bvertrieb\w*\b", r"\bbuchhaltung\b", r"\brechnungswesen\b", r"\blogistik\w*\b", r"\bjuridic\w*\b",
    r"\bjuristisch\w*\b", r"\bpolitik\w*\b", r"\bregierung\w*\b", r"\bkommunikation\b", r"\badministracj\w*\b", r"\bsprzedaz\w*\b", r"\bventas\b", r"\bcompras\b", r"\bfinanzas\b", r"\bcontabilidad\b", r"\boperacoes\b",
    r"\bgestao\b", r"\brecursos humanos\b", r"\bgebaudesicherheit\b", r"\bit (?:interns?|internships?)\b",
)
BOUNDARY = _any(
    r"\b(?:brand|graphic|visual|motion|marketing|communication|content|creative|packaging|game|level|technical|industrial|fashion|interior|instructional|presentation) design\w*\b",
    r"\b(?:developer|designer|design|technical) (?:advocate|evangelist|relations)s?\b", r"\bdevrel\b", r"\bproduct analysts?\b", r"\bproduct owners?\b", r"\bbusiness intelligence\b",
)
UNLISTED = _any(r"\bwelding\b(?! engineer)", r"\btooling\b(?! engineer)", r"\bfacilities engineer\w*\b", r"\bconstruction\b(?! engineer)", r"\bphysicists?\b", r"\bchemists?\b", r"\bbiologists?\b", r"\bnuclear\b")
ATS_EARLY_CAREER = r"\b(?:university|campus|early careers?|students?|interns?|internships?|new grads?|graduates?|co ?ops?)\b"
ATS_SENIOR_LEVELS = ("mid_senior_level", "director", "executive")
