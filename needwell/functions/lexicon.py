"""Signal lexicon of the post classifier.

Matching runs on lower-cased text, so every pattern is lower-case.
"""

from __future__ import annotations

# The phrases that decide a post's category. They are data, kept
# together in reporting order; results depend on each of them.

REQUEST = (
    r"\b(?:we(?:['’]?re| are)|i(?:['’]?m| am))\s+(?:currently\s+|now\s+)?"
    r"(?:looking for|searching for|on the hunt for|in the market for|seeking|after)\b",
    r"\b(?:we|i)\s+(?:need|require|want)\b",
    r"\bin need of\b",
    r"\bcalling for (?:a|an)\b",
    r"(?:^|[.!?\n]\s*)(?:looking for|searching for|seeking)\s+(?:a|an|some|our)\b",
    r"(?:^|[.!?\n]\s*)need (?:a|an|someone|help)\b",
)

TARGET = (
    r"\b(?:agenc(?:y|ies)|freelancers?|contractors?|consultants?|marketers?|"
    r"strateg(?:ist|ists|y)|specialists?|experts?|editors?|designers?|developers?|"
    r"writers?|creators?|managers?|help|partner|vendor|support|someone)\b",
)

CALL_TO_ACTION = (
    r"\b(?:dm|pm|message|ping|contact|email|inbox)\s+me\b",
    r"\bkindly\s+dm\b",
    r"\bdrop me a (?:message|line|note)\b",
    r"\bsend (?:me )?(?:your |a )?(?:portfolio|showreel|reel|resume|cv|note|rates|proposal)\b",
    r"\bif you(?:'d| would) like to be considered\b",
    r"\bhappy to share (?:the )?(?:scope|budget|brief|details)\b",
)

JOB = (
    r"\b(?:we(?:['’]?re| are)\s+|now\s+|urgent(?:ly)?\s+)?hiring\b",
    r"\bapply (?:now|here|today|online|via|at|using|by|through)\b",
    r"\bfull[\s-]?time\b",
    r"\bpart[\s-]?time\b",
    r"\bsalary\b",
    r"\bbenefits package\b",
    r"\b(?:applicants?|candidates?)\b",
    r"\bjob (?:opening|opportunit(?:y|ies)|posting|description|vacanc(?:y|ies))\b",
    r"\bnew (?:role|position|opening|vacancy)\b",
    r"\b(?:send|submit|share|email|drop)(?:\s+\w+){0,4}\s+(?:cv|résumé|resume)\b",
    r"\bwe(?:['’]?re| are) looking for (?:a|an|our)\b[^.!?\n]*\bto join (?:our|the|us|my)\b",
)

RECRUITER = (
    r"\bto join (?:us|them|our|the|my)\b",
    r"\blooking for (?:a|an)\b[^.!?\n]*\bto join\b",
    r"\bjoin (?:our|the|my)(?:\s+\w+){0,3}\s+team\b",
    r"\bjoin (?:us|them)\b",
    r"\bcome join\b",
    r"\b(?:on a |work(?:ing)? on a )?freelance basis\b",
    r"\bworking across\b[^.!?\n]*\bclients?\b",
    r"\bgrowing our (?:roster|network|bench|team)\b",
    r"\b(?:add to|expand|grow)\b[^.!?\n]*\b(?:roster|bench)\b",
    r"\bour (?:roster|bench|talent pool)\b",
    r"@[a-z0-9.-]*(?:talent|recruit|staffing|hire|jobs)[a-z0-9.-]*\.",
)

COMPANY_AUTHOR = (
    r"agenc(?:y|ies)|media|studio|marketing|consult(?:ing|ancy)?|digital|"
    r"solutions|talent|labs|interactive|creative co\b|collective",
)

SELF_PROMOTION = (
    r"\bwhy (?:hire|choose|work with|you (?:need|should))\b",
    r"\bhow to (?:find|choose|hire|pick|select|vet)\b[^.!?\n]*\b(?:the right|a|an|your)\b",
    r"\b\d+\s+(?:reasons|benefits|signs|tips|ways|things)\b",
    r"\btop\s+\d+\b",
    r"\bbenefits of (?:hiring|working with|outsourcing to)\b",
    r"\bhere are (?:the|\d+)\b",
)

CONTENT_NOISE = (
    r"\bone thing i(?:['’]ve| have) been thinking\b",
    r"\byou know (?:those|that|when)\b",
    r"\bhere['’]s why\b",
    r"\bwhen a (?:business owner|company|founder|client)\b",
    r"\b(?:hot take|unpopular opinion|controversial opinion)\b",
    r"\blet['’]s talk about\b",
    r"\bever wonder(?:ed)?\b",
    r"\bthink about it\b",
    r"\bwatch out for\b",
    r"\bpro tip\b",
    r"\bhere['’]s what\b",
    r"\bstop doing\b",
    r"\bthis article\b",
    r"\bworth (?:a )?read(?:ing)?\b",
    r"\bread (?:the|this|my|our) (?:article|full|blog|post|piece|breakdown)\b",
    r"\breviewed (?:seven|eight|nine|ten|\d+|several|some)\b",
    r"\bcheck out (?:this|my|our) (?:article|blog|post|piece|guide)\b",
    r"\blink in (?:the )?comments\b",
    r"\b(?:new|latest) (?:blog|post|article|newsletter)\b",
    r"\bjust (?:published|wrote|posted)\b",
    r"\bi recently (?:received|got|saw|came across)\b",
    r"\bthese scammers\b",
    r"\b(?:true story|storytime|story time)\b",
    r"\ba (?:client|friend|founder) (?:once|recently)\b",
    r"\bwhen i met\b",
    r"\bwanted to work with (?:her|him|them)\b",
    r"\bis so special\b",
    r"\bso grateful (?:to|for)\b",
    r"\bshout[\s-]?out to\b",
    r"\bhighly recommend working with\b",
    r"\bhad the pleasure of working\b",
    r"\bi survived\b",
    r"\bmy journey\b",
    r"\bsat down reflecting\b",
    r"\b20\d{2}:",
    r"\bin 20\d{2} i\b",
)

# Wording that marks an explicit search for help.
SOLICITATION = (
    r"\b(?:looking for|look for|searching for|in search of|need(?:ed)?|want|"
    r"seeking|recommend|recommendations?|anyone know|can anyone|hire|hiring|"
    r"outsource|help with|who (?:can|do you)|any (?:recommendations|suggestions))\b",
)

# Words that say nothing about a need.
STOP_WORDS = ("a", "an", "the", "for", "of", "and", "to", "in")

# Signal groups under the names used in score breakdowns.
GROUPS = {
    "request": REQUEST,
    "target": TARGET,
    "cta": CALL_TO_ACTION,
    "job": JOB,
    "recruiter": RECRUITER,
    "company_author": COMPANY_AUTHOR,
    "selfpromo": SELF_PROMOTION,
    "content_noise": CONTENT_NOISE,
}
