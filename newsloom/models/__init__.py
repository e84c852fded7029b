"""Recommenders: fit on tables, then rank items for all users in one plan."""

from newsloom.models.base import Recommender, users_frame
from newsloom.models.bias import UserItemBias
from newsloom.models.click import ClickModel
from newsloom.models.cosine import CosineProfiles
from newsloom.models.hybrid import PopularityUserCF
from newsloom.models.item_cf import ItemCF
from newsloom.models.popularity import MostPopular
from newsloom.models.profile import WeightedProfiles
from newsloom.models.ring_buffer import RingBuffer
from newsloom.models.topic_cf import TopicCF
from newsloom.models.user_cf import UserCF

__all__ = [
    "ClickModel",
    "CosineProfiles",
    "ItemCF",
    "MostPopular",
    "PopularityUserCF",
    "Recommender",
    "RingBuffer",
    "TopicCF",
    "UserCF",
    "UserItemBias",
    "WeightedProfiles",
    "users_frame",
]
