"""The built-in profiles. Names, file patterns, markers and the frameworks' own words are fixed values. Routes, calls and queues
are rules on the calls that ``functions/code.py`` finds; models are found by expressions over a class's text."""

from __future__ import annotations

from knowmill.profiles.shapes import GAP, STRING, DOUBLE, any_of, argument, setting, verbs

VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
CLIENT = ("get", "post", "put", "delete", "patch", "head", "options")
COMMON, BASIC = CLIENT[:6], CLIENT[:5]

# File patterns by language.
JS = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mjs"]
NODE = [*JS, "**/*.cjs"]
BROWSER = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.mjs"]
FILES = {"python": ["**/*.py"], "go": ["**/*.go"], "rust": ["**/*.rs"], "csharp": ["**/*.cs"], "php": ["**/*.php"], "ruby": ["**/*.rb"], "java": ["**/*.java", "**/*.kt"], "swift": ["**/*.swift"], "elixir": ["**/*.ex", "**/*.exs"], "typescript": BROWSER}


def profile(name: str, language: str, markers: list[str], rules: list[dict], files: list[str] | None = None, **more) -> dict:
    return {"name": name, "language": language, "file_patterns": files or FILES[language], "markers": markers, "rules": rules, **more}


def imports(*modules: str, also: tuple[str, ...] = ()) -> list[str]:
    """The ways in which a script names a module."""
    return [x for m in modules for x in (f'from "{m}"', f"from '{m}'", f"require('{m}')", f'require("{m}")')] + list(also)


def rule(names: dict[str, str] | list[str], owners: tuple[str, ...] = (), sep: str = "(", pos: int = 0, keys: tuple[str, ...] = (), **more) -> dict:
    """Calls of these names whose owner ends with one of ``owners`` ("*": has any); the value is the first argument that has one
    of ``keys`` or is at ``pos`` without a key. ``names`` may map each name to a verb or role; the name "" is any.

    More: ``verb_pos``, ``verb_key``, ``after`` (the verb is that argument, or the word behind ``after`` in it), ``without`` (a
    mark that the value must not have), ``optional`` (the value may lack), ``least`` and ``most`` (arguments), ``word`` (a name
    of a constant will do as well)."""
    return {"names": names if isinstance(names, dict) else dict.fromkeys(names, ""), "owners": list(owners), "sep": sep, "pos": pos, "keys": list(keys)} | {"verb_pos": -1, "verb_key": "", "after": "", "without": "", "optional": False, "least": 0, "most": 1 << 30, "word": False} | more


def named(words, before: str = "", after: str = "", case=str) -> dict[str, str]:
    """Methods or annotations that bear the name of a verb."""
    return {before + case(w) + after: w.upper() for w in words}


def verb_calls(owners, words=VERBS, case=str, after: str = "", **more) -> dict:
    """owner.verb("text")."""
    return rule(named(words, after=after, case=case), owners, **more)


def queue(role: str, names: list[str], owners: tuple[str, ...] = (), word: bool = True, **more) -> dict:
    return rule(dict.fromkeys(names, role), owners, word=word, **more)


MAPPING = rule(named(VERBS, "@", "Mapping", str.title), keys=("value", "path"))
FLASK = ("@app", "@bp", "@blueprint")

REST = [
    profile("actix", "rust", ["use actix_web", "extern crate actix_web", "actix_web::"], [rule(["route"], ("*",), verb_pos=1, after="web::")]),
    profile("aspnet", "csharp", ["using Microsoft.AspNetCore", "[ApiController]", ": ControllerBase", ": Controller"], [rule(named(VERBS, "Http", case=str.title), ("[",), sep=sep, optional=True) for sep in "(["], settings={"prefix": rule(["Route"], ("[",))}, controller_token=True),
    profile("django", "python", ["from django.urls import", "from django.conf.urls import", "urlpatterns ="], [rule({"path": "PATH", "re_path": "RE_PATH"})]),
    profile("echo", "go", ["github.com/labstack/echo", "echo.New("], [verb_calls(("e", "router", "g", "api", "server"), case=str.upper)]),
    profile("express", "typescript", imports("express"), [verb_calls(("app", "router", "api", "Router()"))], NODE),
    profile("fastapi", "python", ["from fastapi import", "import fastapi", "from fastapi.routing import", "FastAPI(", "APIRouter("], [verb_calls(("@app", "@router", "@api"))]),
    profile("fastify", "typescript", imports("fastify", also=("Fastify(",)), [verb_calls(("fastify", "app", "server"))], NODE),
    profile("flask", "python", ["from flask import", "import flask", "Flask(__name__)"], [verb_calls(FLASK), rule({"route": "GET"}, FLASK, verb_key="methods")]),
    profile("gin", "go", ["github.com/gin-gonic/gin", "gin.Default()", "gin.New()"], [verb_calls(("r", "router", "group", "api", "e", "engine"), case=str.upper)]),
    profile("hono", "typescript", ['from "hono"', "from 'hono'", 'from "hono/', "from 'hono/", "new Hono("], [verb_calls(("app", "router", "api", "hono"), (*VERBS, "all"))], JS),
    profile("koa", "typescript", [*imports("@koa/router")[:2], *imports("koa-router")[:2], "require('@koa/router')", 'require("koa-router")', "new Router("], [verb_calls(("router", "api", "app"))], NODE),
    profile("laravel", "php", ["use Illuminate\\Support\\Facades\\Route", "Route::", "Illuminate\\Routing"], [verb_calls(("Route", "$router"), (*VERBS, "any"))]),
    profile("phoenix", "elixir", ["use Phoenix.Router", "Phoenix.Router", ":router"], [verb_calls((), sep=" ", least=2)]),
    profile("rails", "ruby", ["Rails.application.routes.draw", "ActionController::Base", "ApplicationController", "ActionController::API"], [verb_calls((), sep=" ")]),
    profile("rocket", "rust", ["use rocket", "extern crate rocket", "#[macro_use] extern crate rocket"], [verb_calls(("#[",))]),
    profile("slim", "php", ["use Slim\\App", "Slim\\Factory\\AppFactory", "\\Slim\\App", "Slim\\App"], [verb_calls(("$app",), (*VERBS, "any"))]),
    profile("spring", "java", ["import org.springframework", "@RestController", "@Controller"], [MAPPING]),
    profile("vapor", "swift", ["import Vapor", "app.routes", "app.group("], [verb_calls(("app", "routes", "grouped"))]),
]

# RestTemplate's methods, and the verbs that they send.
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH", "headForHeaders": "HEAD", "optionsForAllow": "OPTIONS"}

CLIENTS = [
    profile("aiohttp", "python", ["import aiohttp", "from aiohttp"], [verb_calls(("session",), COMMON, without="{")], settings={"url": rule(["ClientSession"], pos=-1, keys=("base_url",))}),
    profile("angular_httpclient", "typescript", ["@angular/common/http", "HttpClient"], [verb_calls(("this.http", "httpClient", "HttpClient"), CLIENT, without="$")], ["**/*.ts", "**/*.tsx"]),
    profile("axios", "typescript", imports("axios"), [verb_calls(("*",), CLIENT, without="$"), rule([""], pos=-1, keys=("url",), verb_key="method")], settings={"url": rule(["create"], ("axios",), pos=-1, keys=("baseURL",))}),
    profile("dotnet_httpclient", "csharp", ["using System.Net.Http", "HttpClient"], [verb_calls(("*",), BASIC, str.title, "Async", without="{")], settings={"url": rule(["Uri"], ("new",), target="BaseAddress")}),
    profile("faraday", "ruby", ["require 'faraday'", 'require "faraday"'], [verb_calls(("Faraday", "conn", "client"), COMMON, without="#")], settings={"url": rule(["new"], ("Faraday",), pos=-1, keys=("url",))}),
    profile(
        "feign",
        "java",
        ["org.springframework.cloud.openfeign", "@FeignClient"],
        [MAPPING, rule(["@RequestMapping"], pos=-1, keys=("value", "path"), verb_key="method", after="RequestMethod.")],
        settings={"service": rule(["@FeignClient"], keys=("name", "value")), "url": rule(["@FeignClient"], pos=-1, keys=("url",)), "prefix": rule(["@FeignClient"], pos=-1, keys=("path",))},
    ),
    profile("fetch", "typescript", ["fetch(", 'from "undici"', "require('undici')", "from 'node-fetch'"], [rule({"fetch": "GET"}, verb_key="method", without="$")]),
    profile("go_nethttp", "go", ["net/http"], [rule({"Get": "GET", "Post": "POST", "Head": "HEAD", "PostForm": "POST"}, ("http",)), rule(["NewRequest"], ("http",), pos=1, verb_pos=0, after="http.Method"), rule(["NewRequestWithContext"], ("http",), pos=2, verb_pos=1, after="http.Method")]),
    profile("got", "typescript", [*imports("got")[:1], "require('got')", 'from "superagent"', "require('superagent')"], [verb_calls(("got", "superagent", "request"), COMMON, without="$"), rule({"got": "GET"}, without="$")], settings={"url": rule([""], pos=-1, keys=("prefixUrl",))}),
    profile("guzzle", "php", ["use GuzzleHttp\\Client", "GuzzleHttp"], [rule(["request"], ("*",), pos=1, verb_pos=0), verb_calls(("*",), COMMON)], settings={"url": rule([""], pos=-1, keys=("base_uri",))}),
    profile("httparty", "ruby", ["require 'httparty'", "include HTTParty"], [verb_calls(("HTTParty",), COMMON, without="#")]),
    profile("httpx", "python", ["import httpx", "from httpx"], [verb_calls(("httpx", "client"), CLIENT, without="{")], settings={"url": rule(["Client", "AsyncClient"], pos=-1, keys=("base_url",))}),
    profile("jquery", "typescript", ['"jquery"', "'jquery'", "$.ajax", "$.get", "$.post"], [rule({"get": "GET", "post": "POST", "getJSON": "GET"}, ("$",), without="$"), rule({"ajax": "GET"}, ("$",), pos=-1, keys=("url",), without="$")]),
    profile("ky", "typescript", imports("ky"), [verb_calls(("ky",), COMMON, without="$"), rule({"ky": "GET"}, without="$")], settings={"url": rule([""], pos=-1, keys=("prefixUrl",))}),
    profile("requests", "python", ["import requests", "from requests"], [verb_calls(("requests", "session", "s"), CLIENT, without="{"), rule(["request"], ("requests",), pos=1, verb_pos=0, without="{")]),
    profile("reqwest", "rust", ["use reqwest", "reqwest::"], [rule({"get": "GET"}, ("reqwest",)), verb_calls(("client",), COMMON), rule(["request"], ("*",), pos=1, verb_pos=0, after="Method::")]),
    profile("restsharp", "csharp", ["using RestSharp"], [rule({"RestRequest": "GET"}, ("new",), verb_pos=1, after="Method.", without="{")], settings={"url": rule(["RestClient"], ("new",))}),
    profile("resttemplate", "java", ["org.springframework.web.client.RestTemplate", "RestTemplate"], [rule(REST_TEMPLATE, ("restTemplate",)), rule(["exchange"], ("restTemplate",), verb_pos=1, after="HttpMethod.")]),
    profile("resty", "go", ["go-resty/resty"], [verb_calls(("*",), CLIENT, str.title, most=1)], settings={"url": rule(["SetBaseURL"])}),
    profile("vue_resource", "typescript", ["vue-resource", "$http"], [verb_calls(("$http", "Vue.http"), BASIC, without="$")], ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.vue"]),
    profile("webclient", "java", ["org.springframework.web.reactive.function.client.WebClient", "WebClient"], [rule({"uri": v.upper()}, (f"{v}()",)) for v in VERBS], settings={"url": rule(["baseUrl"])}),
    profile("xhr", "typescript", ["XMLHttpRequest", ".open("], [rule(["open"], ("*",), pos=1, verb_pos=0, without="$")]),
]

CONVERT = ["convertAndSend", "convertSendAndReceive"]
QUEUES = [
    profile("amqplib", "typescript", imports("amqplib"), [queue("consumer", ["consume"]), queue("producer", ["sendToQueue"]), queue("producer", ["publish"], word=False, pos=1)]),
    profile("bullmq", "typescript", imports("bullmq"), [queue("producer", ["Queue"], ("new",)), queue("consumer", ["Worker"], ("new",))]),
    profile("confluent_kafka", "python", ["from confluent_kafka", "import confluent_kafka"], [queue("consumer", ["subscribe"]), queue("producer", ["produce"])]),
    profile("kafkajs", "typescript", imports("kafkajs"), [queue("consumer", ["subscribe"], pos=-1, keys=("topic",)), queue("producer", ["send"], pos=-1, keys=("topic",))]),
    profile("pika", "python", ["import pika"], [queue("consumer", ["basic_consume"], pos=-1, keys=("queue",)), queue("producer", ["basic_publish"], pos=-1, keys=("routing_key",))]),
    profile("segmentio_kafka", "go", ["segmentio/kafka-go", "kafka.NewReader", "kafka.NewWriter"], [queue("consumer", ["NewReader"], pos=-1, keys=("Topic",)), queue("producer", ["NewWriter"], pos=-1, keys=("Topic",)), queue("producer", ["Topic"], ("*",), sep="=")]),
    profile(
        "spring_amqp",
        "java",
        ["org.springframework.amqp", "@RabbitListener", "convertAndSend", "sendAndReceive"],
        [queue("consumer", ["@RabbitListener"], pos=-1, keys=("queues",)), queue("producer", CONVERT, pos=1, least=3), queue("producer", CONVERT, word=False), queue("producer", CONVERT, least=2), queue("producer", ["sendAndReceive"], ("*",), pos=1)],
    ),
    profile("spring_kafka", "java", ["org.springframework.kafka", "@KafkaListener", "kafkaTemplate"], [queue("consumer", ["@KafkaListener"], pos=-1, keys=("topics",)), queue("producer", ["send"], ("kafkaTemplate",), word=False), queue("producer", ["send"], ("kafkaTemplate",), least=2)]),
]

NAME, DOTTED = r"(\w+)", r"([\w.]+)"


def word(quotes: str, name: str = NAME) -> str:
    """A name between quotes."""
    return f"[{quotes}]{name}[{quotes}]"


def heir(bases: list[str], link: str, end: str = "") -> str:
    """class Name, its link to a base, and the base."""
    return rf"class\s+{NAME}{GAP}{link}{any_of(bases)}{end}"


def related(**marks: list[str]) -> list[dict]:
    return [{"regex": m, "type": kind} for kind, ms in marks.items() for m in ms]


def model(name: str, language: str, files: list[str], markers: list[str], **rest) -> dict:
    return {"name": name, "language": language, "file_patterns": files, "markers": markers, **rest}


ORM = [
    model(
        "activerecord",
        "ruby",
        ["**/app/models/**/*.rb", "**/*.rb"],
        ["< ApplicationRecord", "< ActiveRecord::Base", "has_many", "belongs_to"],
        table_from_class="snake_case_plural",
        table=setting(r"self\.table_name", word(STRING)),
        relationships=related(one_to_many=["has_many"], many_to_one=["belongs_to"], one_to_one=["has_one"], many_to_many=["has_and_belongs_to_many"]),
        column=r"t\." + verbs(("string", "integer", "text", "boolean", "datetime", "decimal", "float", "references")) + rf"\s+:{NAME}",
        **{"class": heir(["ApplicationRecord", "ActiveRecord::Base"], f"<{GAP}")},
    ),
    model(
        "django",
        "python",
        ["**/models.py", "**/models/**/*.py"],
        ["models.Model", "class Meta", "db_table"],
        table_from_class="snake_case_plural",
        table=setting("db_table", word(STRING, DOTTED)),
        relationships=related(many_to_one=[r"models\.ForeignKey"], many_to_many=[r"models\.ManyToManyField"], one_to_one=[r"models\.OneToOneField"]),
        column=setting(NAME, r"models\."),
        **{"class": heir([r"models\.Model"], r"\(", r"\)")},
    ),
    model(
        "entity_framework",
        "csharp",
        ["**/*.cs"],
        ["[Table(", "DbSet<", ": DbContext", "[Column("],
        table_from_class="snake_case_plural",
        table=argument(r"\[Table", word(DOUBLE)) + rf"{GAP}\)\]",
        relationships=related(many_to_one=[r"\[ForeignKey\("], one_to_many=[r"\.HasMany\("], one_to_one=[r"\.HasOne\("], many_to_many=[r"\.WithMany\("]),
        column=argument(r"\[Column", word(DOUBLE)) + rf"{GAP}\)\]",
        **{"class": rf"public\s+class\s+{NAME}(?:{GAP}:{GAP}(?!DbContext)\w+)?"},
    ),
    model(
        "jpa",
        "java",
        ["**/*.java"],
        ["@Entity", "@Table", "extends JpaRepository", "extends CrudRepository"],
        table_from_class="lower_case",
        table=rf"@Table{GAP}\([^)]*?" + setting("name", word(DOUBLE)),
        schema=rf"@Table{GAP}\([^)]*?" + setting("schema", word(DOUBLE)),
        relationships=related(one_to_many=["@OneToMany"], many_to_one=["@ManyToOne"], many_to_many=["@ManyToMany"], one_to_one=["@OneToOne"]),
        column=argument("@Column", setting("name", word(DOUBLE))),
        **{"class": rf"@Entity[\s\S]*?class\s+{NAME}"},
    ),
    model(
        "prisma",
        "typescript",
        ["**/schema.prisma", "**/prisma/schema.prisma"],
        ["^model\\s+\\w+", "@@map", "@relation"],
        table_from_class="snake_case_plural",
        table=argument("@@map", word(DOUBLE)) + rf"{GAP}\)",
        relationships=related(many_to_one=[r"\b\w+\s+([A-Z]\w*)\s+@relation\b"], one_to_many=[r"\b\w+\s+([A-Z]\w*)\[\]"]),
        column=rf"^\s+{NAME}\s+\w+",
        **{"class": rf"^model\s+{NAME}{GAP}\{{"},
    ),
    model(
        "sqlalchemy",
        "python",
        ["**/*.py"],
        ["declarative_base()", "__tablename__", "Column("],
        table_from_class="snake_case",
        table=setting("__tablename__", word(STRING, DOTTED)),
        relationships=related(relationship=[r"relationship\("], foreign_key=[r"ForeignKey\("]),
        column=setting(NAME, r"Column\("),
        **{"class": heir(["Base"], r"\(.*", r".*\)")},
    ),
    model(
        "typeorm",
        "typescript",
        ["**/*.ts", "**/*.js"],
        ["@Entity(", "@Column(", "@PrimaryGeneratedColumn(", "@JoinColumn("],
        table_from_class="snake_case",
        table=argument("@Entity", word(STRING)) + rf"{GAP}\)",
        relationships=related(one_to_many=[r"@OneToMany\("], many_to_one=[r"@ManyToOne\("], many_to_many=[r"@ManyToMany\("], one_to_one=[r"@OneToOne\("]),
        column=rf"@Column\([^)]*\)\s*{NAME}",
        **{"class": rf"@Entity[\s\S]*?class\s+{NAME}"},
    ),
]

BUILTIN = {"rest": REST, "client": CLIENTS, "queue": QUEUES, "orm": ORM}
