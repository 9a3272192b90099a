"""Closed vocabularies and constants of the event schema. Results depend on them."""

from __future__ import annotations

CELLS = ("pubg", "nba", "csgo", "rocket_league", "poker")

# Event types that count as a decision in every cell.
ACTIONABLE = (
    "resource_gain", "resource_spend", "resource_budget", "resource_trade", "resource_depleted",
    "position_commit", "zone_enter", "zone_exit", "route_decision", "rotation_commit",
    "engage_decision", "disengage_decision", "target_select", "ability_use", "item_use",
    "objective_contest", "objective_capture", "objective_abandon",
    "team_coordinate", "draft_pick", "draft_ban",
    "strategy_adapt", "risk_accept", "risk_reject", "concede",
    "timing_commit", "delay_action", "force_action",
)

# Event types that count only in one cell.
CELL_ACTIONABLE = {
    "fortnite": ("storm_rotation", "build_decision"),
    "pubg": (),
    "nba": ("shot_selection", "clutch_decision"),
    "csgo": ("buy_decision", "utility_deploy", "bombsite_commit"),
    "rocket_league": ("aerial_commit", "boost_steal", "rotation_back"),
    "poker": ("pot_odds_decision", "stack_pressure", "hand_strength_commitment"),
}

# Chain lengths, gate floor and test settings.
CHAIN_LENGTH = {"pubg": 8, "nba": 5, "csgo": 10, "rocket_league": 12, "poker": 8, "fortnite": 8}
GATE_FLOOR = 0.5
ALPHA, BONFERRONI, MIN_DISCORDANT = 0.05, 5, 10
ZONE_TRIGGERS = ("zone_enter", "zone_exit", "position_commit")
BUILD_TRIGGERS = ("build_decision", "resource_spend", "resource_budget")

# Rule texts and the names that questions use.
RULES = {
    "fortnite": "In Fortnite, players must remain within the safe storm zone or take damage over time. An eliminated player cannot generate further actions. Building structures consumes exactly one material per piece.",
    "pubg": "Players must stay inside the shrinking safe zone; remaining outside deals damage that increases per phase. An eliminated player cannot act. Squads consist of up to 4 players who can revive downed teammates.",
    "nba": "Offensive team must shoot within 24 seconds of gaining possession. A player with 6 fouls is ejected. Possession changes on made shots, turnovers, defensive rebounds.",
    "csgo": "T wins by detonating bomb or eliminating CTs. CT wins by defusing bomb, eliminating Ts, or time expiring. Eliminated players don't respawn until next round. Bomb plants only at sites A or B.",
    "rocket_league": "Teams of 3 score by hitting the ball into the opposing goal. Boost meter caps at 100; collected from pads. A goal resets ball and player positions for a kickoff.",
    "poker": "Rules: fold/check/call/bet/raise up to stack. Cannot wager more than held. Action proceeds clockwise. Folded player can't act again. Best 5-card hand wins at showdown.",
}
DOMAIN = {"fortnite": "Fortnite", "pubg": "PUBG", "nba": "NBA basketball", "csgo": "Counter-Strike", "rocket_league": "Rocket League", "poker": "poker"}
QUESTION = "Is the sequence of events above consistent with the rules of %s?\nReply with exactly one word: YES or NO."
# The questions of the diagnostic and of the citation, what a question may be preceded by, and what stands
# for rules and question where a cell has none.
DIAGNOSTIC = (
    "Does the sequence of events above contain any event that violates the rules of %s?\n\n"
    "Most sequences are valid. Only reply YES if you can identify both (a) which specific listed rule is broken, and (b) which specific event in the sequence breaks it. "
    "Do not infer violations from unusual, rare, or incomplete patterns. Ignore artifacts in formatting, timing, or score reporting.\n\n"
    "Reply with exactly one word: YES (a violation is present) or NO."
)
CITATION = (
    "You evaluated this sequence and concluded it contains a rule violation.\n\nFrom the constraint context above, identify:\n"
    "(a) Which specific rule (quote it directly from the constraint context)\n(b) Which event number(s) (0-indexed) caused the violation\n\n"
    "Reply in this exact format on two lines:\nRULE: <quoted rule>\nEVENTS: <comma-separated event numbers>"
)
IGNORE_TIMES = "Note: ignore timestamps when evaluating rule violations. Focus only on whether any event in the sequence breaks the stated rules.\n\n"
NO_RULES = (
    "[CONSTRAINT CONTEXT FOR %s — TO BE DEFINED AT T-DESIGN]\nPer SPEC §6 (T design), the constraint context language is locked during the T-design joint authoring session. "
    "This default is a placeholder so prompt construction can be tested infrastructure-side."
)
NO_QUESTION = "[QUESTION TBD AT T-DESIGN]\nPredict the actor or event-type that follows. Reply with a single token only."
# The rule that each cell's planted violation breaks, and the streets of a hand in order.
CLAUSES = {
    "nba": "A player with 6 fouls is ejected", "pubg": "An eliminated player cannot act", "rocket_league": "A goal resets ball and player positions for a kickoff",
    "poker": "A folded player cannot act again", "csgo": "Eliminated players don't respawn until next round",
}
STREETS = ("preflop", "flop", "turn", "river")
# Fixed value: answers that abstain.
ABSTAIN = r"(?i)^\s*(i\s*don'?t\s*know|abstain|n/?a|unknown|cannot\s*determine|insufficient|no\s*answer|skip)\s*\.?\s*$"
