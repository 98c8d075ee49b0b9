"""Word lists and cues of the supported language, as data."""

from __future__ import annotations

#: Abbreviations that end or hold a dot without ending a sentence; each also occurs with a capital.
ABBREVIATIONS = [
    "alm.", "ang.", "art.", "bl.a.", "ca.", "d.d.", "dkr.", "ds.", "d.å.", "dvs.", "ekskl.", "el.lign.", "etc.", "evt.", "f.eks.", "fg.", "fhv.", "fmd.", "ff.", "f.",
    "flg.", "hhv.", "inkl.", "j.nr.", "jf.", "kgl.", "kl.", "kr.", "lign.", "maks.", "mht.", "md.", "mdr.", "mdl.", "m.fl.", "m.m.", "m.v.", "mia.", "mio.", "nkr.",
    "nfmd.", "nr.", "o.lign.", "osv.", "o.k.", "pga.", "pr.", "pct.", "pkt.", "p.u.v.", "s.", "sek.", "skr.", "stk.", "td.", "tdr.", "vedr.",
]

#: Month names.
MONTHS = ["januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december"]

#: Cues of references to all other subsections of the paragraph.
RELATIVE_CUES = [" overtrædelse af disse bestemmelser", " overtrædelse af denne bestemmelse", " denne paragrafs bestemmelser", " ovennævnte regler"]

#: Cues of references to the whole law at hand.
WHOLE_LAW_CUES = [" denne lov", " for lovens anvendelse", " denne lovs bestemmelser", " loven", " lovens"]

#: Cues of other laws, and the law's id where it is known.
EXTERNAL_CUES = [
    (" barselloven", "LBK nr 235 af 12/02/2021"),
    (" dansk lovgivning om social sikring", ""),
    (" direktiv nr. 92/85/EØF om iværksættelse af foranstaltninger til forbedring af sikkerheden og sundheden under arbejdet for arbejdstagere", ""),
    (" EF-forordninger om koordinering af de sociale sikringsordninger", ""),
    (" ferieloven", ""),
    (" funktionærloven", "LBK nr 1002 af 24/08/2017"),
    (" lov om afgift af lønsum m.v.", ""),
    (" lov om aktiv socialpolitik", ""),
    (" lov om Arbejdsmarkedets Tillægspension", ""),
    (" lov om arbejdsløshedsforsikring m.v.", ""),
    (" lov om brug af køberet eller tegningsret til aktier m.v.", "LOV nr 309 af 05/05/2004"),
    (" lov om børnetilskud", ""),
    (" lov om dagpenge ved sygdom eller fødsel", ""),
    (" lov om en aktiv beskæftigelsesindsats", ""),
    (" lov om en satsreguleringsprocent", ""),
    (" lov om et indkomstregister", ""),
    (" lov om fleksydelse", ""),
    (" lov om højeste, mellemste, forhøjet almindelig og almindelig førtidspension m.v.", ""),
    (" lov om ligebehandling af mænd og kvinder med hensyn til beskæftigelse m.v.", ""),
    (" lov om pas til danske statsborgere m.v.", ""),
    (" lov om retssikkerhed og administration på det sociale område", ""),
    (" lov om social pension", ""),
    (" lov om social service", ""),
    (" lov om statens voksenuddannelsesstøtte", ""),
    (" lov om sygedagpenge", ""),
    (" lov om tidsbegrænset ansættelse", "LBK nr 907 af 11/09/2008"),
    (" momsloven", ""),
    (" renteloven", ""),
    (" SU-loven", ""),
    (" straffeloven", ""),
]

#: A small default list; users pass their own (one word per line, see ``sources.stopwords``).
STOPWORDS = ["the", "of", "and", "a", "to", "in", "is", "og", "i", "at", "der", "die", "und", "de", "la", "le", "el", "et", "en", "que"]
