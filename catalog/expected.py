"""What the SQL expects: the names, labels and limits of the reports, written out apart from the library.

A wrong name in the library so shows as a difference, since nothing here is taken from it.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    event: str
    screen: str
    view: str | None
    label: str


def snake(label: str) -> str:
    """Column name of a display label."""
    return re.sub("[^0-9a-z]+", "_", label.lower()).strip("_")


# --- fixed values: rules, in the order of the reports ---------------------------
ONBOARDING_RULES = (
    Rule("screen_load", "splash_screen", None, "Splash"),
    Rule("screen_load", "initial_login_screen", None, "Initial login screen"),
    Rule("view_click", "initial_login_screen", None, "User click on login button"),
    Rule("screen_load", "login_screen", None, "Login screen load"),
    Rule("view_click", "login_screen", None, "User click on continue button after login screen"),
    Rule("screen_load", "verify_otp_screen", None, "Land on OTP screen"),
    Rule("view_click", "verify_otp_screen", None, "User click on continue button after otp"),
    Rule("screen_load", "create_profile_screen", None, "Profile Screen"),
    Rule("view_click", "create_profile_screen", None, "User click on Continue button after profile screen"),
    Rule("screen_load", "bina_savings_tode", None, "User land on Bina Savings tode screen"),
    Rule("view_click", "bina_savings_tode", None, "User clicks on Yes But kaise"),
    Rule("screen_load", "dost_hain", None, "User land on Dost hain Screen"),
    Rule("view_click", "dost_hain", None, "User clicks on haan dost hain"),
    Rule("screen_load", "to_beesi_karo_na", None, "User land on To Beesi Karo na Screen"),
    Rule("view_click", "to_beesi_karo_na", None, "User clicks on nice"),
    Rule("screen_load", "how_beesi_works", None, "User land on How Beesi Works Screen"),
    Rule("view_click", "how_beesi_works", None, "User clicks on got it btn"),
    Rule("screen_load", "home_screen", None, "User lands on Home Screen"),
)
EXPLORE_RULES = (
    Rule("screen_load", "home_screen", None, "User landed on homepage"),
    Rule("view_click", "home_screen", "kyun_karni_hai_beesi", "User click on kyun karni hai beesi"),
    Rule("screen_load", "kyun_karni_hai_beesi", None, "User land on kyun karni hai beesi"),
    Rule("view_click", "kyun_karni_hai_beesi", "cool", "User click on cool on kyun karni hai beesi"),
    Rule("view_click", "kyun_karni_hai_beesi", "back_button", "User click on back button on kyun karni hai beesi"),
    Rule("view_click", "home_screen", "beesi_kya_hai", "User click on beesi kya hai"),
    Rule("screen_load", "beesi_kya_hai", None, "User land on beesi kya hai screen"),
    Rule("play_player", "beesi_kya_hai", None, "User click on play button on beesi kya hai screen"),
    Rule("pause_player", "beesi_kya_hai", None, "User click on pause button on sampling UI video"),
    Rule("view_click", "beesi_kya_hai", "back_button", "User click on back button on beesi kya hai screen"),
    Rule("view_click", "beesi_kya_hai", "create_beesi_group", "User click on create beesi group on beesi kya hai screen"),
)
ONBOARDING_SCREENS = (
    "splash_screen",
    "initial_login_screen",
    "login_screen",
    "verify_otp_screen",
    "create_profile_screen",
    "bina_savings_tode",
    "dost_hain",
    "to_beesi_karo_na",
    "how_beesi_works",
    "home_screen",
)
NO_CUSTOM_EVENT, NO_EVENT, OTHERS = "No custom event", "No Event", "Others"
NOT_WATCHED = "User didnt watch the video"
WATCH_BUCKETS = (
    ("User watched the video for 1-10 seconds", 0, 10),
    ("User watched the video for 11-30 seconds", 10, 30),
    ("User watched the video for 31-60 seconds", 30, 60),
    ("User watched the video for 61-120 seconds", 60, 120),
    ("User watched the video for more than 120 seconds", 120, None),
)
GOAL_CATEGORIES = (
    "iPhone",
    "Gadgets",
    "Electronics",
    "Laptop",
    "Travel",
    "Luxury",
    "Shopping",
    "Jewellery",
    "Savings",
    "Host Party",
    "Bike",
    "Car",
    "Online Education",
)
SOURCE_GROUPS = {
    "Home Screen": ("set_now_home_screen", "create_beesi_home_screen"),
    "Settings Screen": ("edit_goal_settings_screen",),
    "Group Screen": ("set_now_groups_screen", "create_beesi_groups_screen"),
    "Reward Screen Flow": ("set_goal_reward_screen",),
}
WEB_EVENTS = (
    "home_page_view",
    "Open_App_Appstore",
    "Open_App_Playstore",
    "Open_App_Yes_But_Kaise",
    "Open_App_Haan_Dost_Hain",
    "Open_App_Nudge_1",
    "Open_App_Nudge_2",
    "Open_App_Nudge_Floating",
    "Open_App_Whatsapp_Share_App_With_Friends",
)
SCROLL_THRESHOLDS = (20, 40, 60, 80, 100)

# --- fixed values: lists that the test rows pick from -----------------------------
SCREENS = (
    "splash_screen",
    "initial_login_screen",
    "login_screen",
    "verify_otp_screen",
    "create_profile_screen",
    "bina_savings_tode",
    "dost_hain",
    "to_beesi_karo_na",
    "how_beesi_works",
    "home_screen",
    "kyun_karni_hai_beesi",
    "beesi_kya_hai",
    "set_goal_bottomsheet",
)
GOALS = (
    "Buy iPhone 15",
    "gadgets",
    "Electronics",
    "New Laptop",
    "Travel to Goa",
    "Luxury",
    "Shopping",
    "Jewellery",
    "Savings",
    "Host Party",
    "Bike",
    "Car",
    "Online Education",
    "Scarf",
    "Wedding",
    None,
)
SOURCES = (
    "set_now_home_screen",
    "create_beesi_home_screen",
    "edit_goal_settings_screen",
    "set_now_groups_screen",
    "create_beesi_groups_screen",
    "set_goal_reward_screen",
    "unknown_source",
    None,
)
WEB_CYCLE = (
    "home_page_view",
    "Open_App_Playstore",
    "Open_App_Appstore",
    "Open_App_Yes_But_Kaise",
    "Open_App_Haan_Dost_Hain",
    "Open_App_Nudge_Floating",
    "Open_App_Nudge_1",
    "Open_App_Nudge_2",
    "Open_App_Whatsapp_Share_App_With_Friends",
    "other_event",
)

ONBOARDING_LABELS = tuple(rule.label for rule in ONBOARDING_RULES)
EXPLORE_LABELS = tuple(rule.label for rule in EXPLORE_RULES)
WATCH_LABELS = (NOT_WATCHED, *(label for label, _, _ in WATCH_BUCKETS))
