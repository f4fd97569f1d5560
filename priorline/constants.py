"""Vocabularies, rates, weights and column lists.

Everything in this module is data that must equal the published values for the
results to be right. Keep it free of logic.
"""

from __future__ import annotations

# --- fixed values: raw pitch columns the pipeline reads -----------------------------------
FIELDER_COLUMNS = [f"fielder_{position}" for position in range(2, 10)]
PITCH_COLUMNS = [
    "game_pk", "at_bat_number", "pitch_number", "batter", "pitcher", "events",
    "stand", "p_throws", "inning_topbot", "home_team", "away_team", "game_date",
    "game_type", "bb_type", "balls", "strikes", "outs_when_up", "inning", "game_year",
    *FIELDER_COLUMNS,
]

# --- fixed values: event vocabulary --------------------------------------------------------
HIT_EVENTS = ["single", "double", "triple", "home_run"]
STRIKEOUT_EVENTS = ["strikeout", "strikeout_double_play"]
WALK_EVENTS = ["walk", "catcher_interf"]
HIT_BY_PITCH_EVENTS = ["hit_by_pitch"]
OUT_EVENTS = [
    "field_out", "force_out", "grounded_into_double_play", "double_play", "triple_play",
    "sac_fly", "sac_bunt", "sac_fly_double_play", "sac_bunt_double_play",
    "field_error", "fielders_choice_out", "fielders_choice",
]
AT_BAT_EVENTS = [
    "single", "double", "triple", "home_run", "strikeout", "strikeout_double_play",
    "field_out", "force_out", "grounded_into_double_play", "double_play", "triple_play",
    "field_error", "fielders_choice", "fielders_choice_out",
]

# --- fixed values: outcome classes ---------------------------------------------------------
OUTCOME_COLUMN = "pa_outcome_category"
UNMAPPED_OUTCOME = 99
OUTCOME_EVENTS = {
    0: OUT_EVENTS,
    1: ["single"],
    2: ["double"],
    3: ["triple"],
    4: ["home_run"],
    5: STRIKEOUT_EVENTS,
    6: WALK_EVENTS,
    7: HIT_BY_PITCH_EVENTS,
}
OUTCOME_LABELS = ["Out_In_Play", "Single", "Double", "Triple", "HomeRun", "Strikeout", "Walk", "HBP"]

# --- fixed values: league rates of the baseline years --------------------------------------
LEAGUE_YEARS = [2021, 2022]
TRAINING_YEARS = [2023, 2024]
TRAINING_MAX_INNING = 3
FIRST_YEAR = 2021
LEAGUE_RATES = {
    "lg_avg": 0.2430046187210952,
    "lg_k_pct": 0.22924091208889638,
    "lg_bb_pct": 0.08148381370630434,
    "lg_hbp_pct": 0.011473038224461158,
    "lg_1b_pct": 0.1402169753195324,
    "lg_2b_pct": 0.0434629195855918,
    "lg_3b_pct": 0.0035882083115064234,
    "lg_hr_pct": 0.030792907181573653,
    "lg_out_pct": 0.6889821376710302,
    "lg_2b_rate_of_hits": 0.179,
    "lg_3b_rate_of_hits": 0.015,
}

# --- fixed values: stabilisation points, in at-bats for avg and plate appearances otherwise -
SHRINKAGE_WEIGHTS = {
    "batter": {
        "avg": 910, "k_pct": 60, "bb_pct": 120, "hbp_pct": 240,
        "1b_pct": 290, "2b_pct": 1600, "3b_pct": 1600, "hr_pct": 170,
    },
    "pitcher": {
        "avg": 630, "k_pct": 70, "bb_pct": 170, "hbp_pct": 640,
        "1b_pct": 670, "2b_pct": 1450, "3b_pct": 1450, "hr_pct": 1320,
    },
}

# --- fixed values: names of the eight model rates, in reporting order ------------------------
PITCHER_RATE_COLUMNS = [
    "pitcher_k_pct_a_daily_input",
    "pitcher_bb_pct_a_daily_input",
    "pitcher_hbp_pct_a_daily_input",
    "pitcher_1b_pct_a_daily_input",
    "pitcher_2b_pct_a_daily_input",
    "pitcher_3b_pct_a_daily_input",
    "pitcher_hr_pct_a_daily_input",
    "pitcher_non_k_out_pct_a_daily_input",
]
BATTER_RATE_COLUMNS = [
    "batter_k_pct_daily_input",
    "batter_bb_pct_daily_input",
    "batter_hbp_pct_daily_input",
    "batter_1b_pct_daily_input",
    "batter_2b_pct_daily_input",
    "batter_3b_pct_daily_input",
    "batter_hr_pct_daily_input",
    "batter_non_k_out_pct_daily_input",
]
CONTINUOUS_COLUMNS = [
    *PITCHER_RATE_COLUMNS,
    *BATTER_RATE_COLUMNS,
    "team_defense_oaa_input",
    "park_factor_input",
]
BINARY_COLUMNS = ["is_platoon_adv", "is_batter_home"]

# --- fixed values: trial reports -----------------------------------------------------------
REPORT_INNINGS = [1, 2, 3]
REPORT_TEAMS = ["away", "home"]
REPORT_STATS = ["H", "BB", "HR", "R"]
REPORT_MAX_BIN = 5
NEUTRAL_PARK_FACTOR = 100.0

# --- fixed values: games that are not to be run ----------------------------------------------
INACTIVE_STATUSES = ["tbd", "postponed", "cancelled", "suspended"]
LEAD_MINUTES = 55
LOCAL_ZONE = "America/New_York"

# --- fixed values: venues with a dome or a retractable roof --------------------------------
DOMED_VENUES = [
    "Rogers Centre", "Tropicana Field", "Minute Maid Park", "Chase Field",
    "T-Mobile Park", "Marlins Park", "Globe Life Field",
]

# --- fixed values: team abbreviation -> club name ---------------------------------------------
TEAM_NAMES = {
    "BOS": "Red Sox", "MIN": "Twins", "LAD": "Dodgers", "CLE": "Guardians", "SD": "Padres",
    "KC": "Royals", "CWS": "White Sox", "WSH": "Nationals", "TB": "Rays", "AZ": "D-backs",
    "MIL": "Brewers", "STL": "Cardinals", "DET": "Tigers", "TEX": "Rangers", "OAK": "Athletics",
    "ATL": "Braves", "PHI": "Phillies", "CIN": "Reds", "NYY": "Yankees", "SEA": "Mariners",
    "NYM": "Mets", "LAA": "Angels", "MIA": "Marlins", "SF": "Giants", "PIT": "Pirates",
    "COL": "Rockies", "HOU": "Astros", "BAL": "Orioles", "TOR": "Blue Jays", "CHC": "Cubs",
}

# Column names of the public headerless game-log layout, in order.
GAME_LOG_COLUMNS = [
    "date", "game_num", "day_of_week", "visiting_team", "visiting_team_league", "visiting_team_game_num",
    "home_team", "home_team_league", "home_team_game_num", "visiting_score", "home_score", "num_outs", "day_night",
    "completion_info", "forfeit_info", "protest_info", "park_id", "attendance", "time_of_game_minutes",
    "visiting_line_score", "home_line_score", "visiting_abs", "visiting_hits", "visiting_doubles",
    "visiting_triples", "visiting_homeruns", "visiting_rbi", "visiting_sac_hits", "visiting_sac_flies",
    "visiting_hbp", "visiting_bb", "visiting_iw", "visiting_k", "visiting_sb", "visiting_cs", "visiting_gdp",
    "visiting_ci", "visiting_lob", "visiting_pitchers_used", "visiting_individual_er", "visiting_er",
    "visiting_wp", "visiting_balks", "visiting_po", "visiting_assists", "visiting_errors", "visiting_pb",
    "visiting_dp", "visiting_tp", "home_abs", "home_hits", "home_doubles", "home_triples", "home_homeruns",
    "home_rbi", "home_sac_hits", "home_sac_flies", "home_hbp", "home_bb", "home_iw", "home_k", "home_sb",
    "home_cs", "home_gdp", "home_ci", "home_lob", "home_pitchers_used", "home_individual_er", "home_er", "home_wp",
    "home_balks", "home_po", "home_assists", "home_errors", "home_pb", "home_dp", "home_tp", "ump_home_id",
    "ump_home_name", "ump_first_id", "ump_first_name", "ump_second_id", "ump_second_name", "ump_third_id",
    "ump_third_name", "ump_lf_id", "ump_lf_name", "ump_rf_id", "ump_rf_name", "visiting_manager_id",
    "visiting_manager_name", "home_manager_id", "home_manager_name", "winning_pitcher_id", "winning_pitcher_name",
    "losing_pitcher_id", "losing_pitcher_name", "save_pitcher_id", "save_pitcher_name", "game_winning_rbi_id",
    "game_winning_rbi_name", "visiting_starting_pitcher_id", "visiting_starting_pitcher_name",
    "home_starting_pitcher_id", "home_starting_pitcher_name", "visiting_1_id", "visiting_1_name", "visiting_1_pos",
    "visiting_2_id", "visiting_2_name", "visiting_2_pos", "visiting_3_id", "visiting_3_name", "visiting_3_pos",
    "visiting_4_id", "visiting_4_name", "visiting_4_pos", "visiting_5_id", "visiting_5_name", "visiting_5_pos",
    "visiting_6_id", "visiting_6_name", "visiting_6_pos", "visiting_7_id", "visiting_7_name", "visiting_7_pos",
    "visiting_8_id", "visiting_8_name", "visiting_8_pos", "visiting_9_id", "visiting_9_name", "visiting_9_pos",
    "home_1_id", "home_1_name", "home_1_pos", "home_2_id", "home_2_name", "home_2_pos", "home_3_id", "home_3_name",
    "home_3_pos", "home_4_id", "home_4_name", "home_4_pos", "home_5_id", "home_5_name", "home_5_pos", "home_6_id",
    "home_6_name", "home_6_pos", "home_7_id", "home_7_name", "home_7_pos", "home_8_id", "home_8_name",
    "home_8_pos", "home_9_id", "home_9_name", "home_9_pos", "misc", "acquisition_info",
]

# Labels of the report.
DISPLAY_NAMES = {
    "probability_pct": "Probability (%)",
    "decimal_odds": "Decimal Odds",
    "american_odds": "American Odds",
    "number_bin": "Count",
    "team_name": "Team Name",
}
BIN_LABELS = ["0", "1", "2", "3", "4", "5+"]
